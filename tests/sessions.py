from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from foliolens.plans.session import tune


def session(cores: int | str = 8) -> SparkSession:
    """A local session for tests, with its own checkpoint folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliolens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
