"""Tables as inputs: files, catalog tables and database tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliolens.model import Labels
from foliolens.schema import LOOKTHROUGHS, POSITIONS


def read_table(
    spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, spread: int | None = None
) -> DataFrame:
    """A stored table. How its files become tasks is up to ``spark.sql.files.*``.

    ``spread`` deals its rows to that many tasks: for a table in a few row groups,
    which can't be split, when each row is to cause much work.
    """
    reader = spark.read.format(kind)
    rows = (reader.schema(schema) if schema else reader).load(path)
    return rows.repartition(spread) if spread else rows


def read_database_table(
    spark: SparkSession,
    url: str,
    table: str,
    columns: list[str],
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 64,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Columns of a database table, read in key ranges when a key is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {}))
    if partition_column is not None and bounds is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load().select(*columns)


def tag(df: DataFrame, container: str, record_type: str = POSITIONS) -> DataFrame:
    return df.withColumns({"container": F.lit(container), "record_type": F.lit(record_type)})


def union_containers(sources: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """One frame of ``(container, record type, rows)`` parts; missing columns are NULL."""
    tagged = [tag(df, container, record_type) for container, record_type, df in sources]
    result = tagged[0]
    for part in tagged[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def from_tables(positions: DataFrame, lookthroughs: DataFrame | None, labels: Labels) -> tuple[DataFrame, DataFrame | None]:
    """Preloaded frames, normalised like parsed requests."""
    from foliolens.model import union_labels
    from foliolens.operators.normalize import normalize

    names = union_labels(labels, 0) + union_labels(labels, 1)
    children = None if lookthroughs is None else normalize(lookthroughs, names, LOOKTHROUGHS)
    return normalize(positions, names, POSITIONS), children
