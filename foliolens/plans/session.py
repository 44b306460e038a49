"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Views become long expressions: methods beyond what the JVM compiles are
    # slower than evaluating operators one by one.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Applies the settings; cluster sizes and memory are left as they are."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark
