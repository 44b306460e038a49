"""Rows of result files are counted per file before their paths are taken apart."""

from __future__ import annotations

from foliolens.datasets import COLUMNS
from foliolens.registry.output_queries import QUERIES

ORDERS = [(n, n % 3, "FOP"[n % 3], 10.0 + n, f"{n % 5 + 1}-X") for n in range(40)]
LINES = [(n, p, 1, p, 2.0, 5.0 * p, "NAR"[p % 3]) for n in range(40) for p in range(1, 5)]


def test_paths_are_taken_apart_once_per_file(spark, tmp_path):
    for name, rows in (("orders", ORDERS), ("lineitem", LINES)):
        spark.createDataFrame(rows, COLUMNS[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = QUERIES["R-04_partition_folders"][0](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    apart = [n for n, line in enumerate(plan) if "regexp_extract" in line]
    counted = [n for n, line in enumerate(plan) if "Aggregate" in line and "count(1)" in line]
    assert len(apart) == len(counted) == 2 and all(a <= c for a, c in zip(apart, counted, strict=True))
    rows = {(r["perspective_id"], r["container"], r["record_type"]): r["rows"] for r in found.collect()}
    kept = [n for n in range(40) if n % 3 == 0 and n % 5 + 1 <= 4]  # view -1 keeps trade types up to 4
    assert rows["-1", "holding", "positions"] == len(kept)
