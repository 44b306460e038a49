from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.sessions import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    yield spark
    spark.stop()


def table(spark, rows: list[dict], schema: str):
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
