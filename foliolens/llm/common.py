"""Helpers that several of these operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolens.plans.reuse import materialize

#: Rows that go to a Python worker at once; long texts make larger batches a burden.
ARROW_ROWS = 400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Spark's setting by which a finished write gives up the shuffle files that it made.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder, so that lost executors cost no recomputation.

    The shuffle files of the write go when it is done: nothing else reads them.
    """
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        return materialize(df)
    finally:
        if before is None:
            conf.unset(FREED)
        else:
            conf.set(FREED, before)


def small_batches(df: DataFrame) -> DataFrame:
    """Bounds what a Python worker holds: fewer rows to a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have yet, whatever the case of the letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def column(name: str) -> Column:
    """A top-level column by its name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(text: str) -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.encode(F.coalesce(column(text).cast("string"), F.lit("")), "UTF-8")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(column(key).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))
