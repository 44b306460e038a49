"""Reference data: point lookups of instruments, parents and allocations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from foliolens.operators.skew import join_groups
from foliolens.schema import INT_NULL, has

MOMENT = "_moment"
"""Column with the date of a row's request."""
PARENT_PREFIX = "parent_"


def _known(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull() & (F.col(column) != INT_NULL)).distinct()


def instrument_ids(positions: DataFrame, lookthroughs: DataFrame | None) -> DataFrame:
    """Distinct instruments of both frames."""
    ids = positions.select("instrument_id")
    if lookthroughs is not None:
        ids = ids.unionByName(lookthroughs.select("instrument_id"))
    return ids.distinct()


def parent_ids(positions: DataFrame) -> DataFrame:
    """Distinct parents of the positions, without missing ones."""
    return _known(positions, "parent_instrument_id")


def allocation_ids(positions: DataFrame) -> DataFrame:
    return _known(positions, "asset_allocation_id")


def _needed(table: DataFrame, key: str, columns: list[str] | None) -> DataFrame:
    lowered = table.toDF(*[c.lower() for c in table.columns])
    if columns is None:
        return lowered
    return lowered.select(*dict.fromkeys([key, *[c.lower() for c in columns]]))


def read_reference(
    table: DataFrame, ids: DataFrame, columns: list[str] | None = None, key: str = "instrument_id"
) -> DataFrame:
    """The needed columns of a reference table for the ids that occur."""
    wanted = ids.toDF(key)
    return _needed(table, key, columns).join(wanted, key, "left_semi")


def read_parent_reference(table: DataFrame, positions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Instrument rows of the positions' parents, under parent names."""
    rows = read_reference(table, parent_ids(positions), columns)
    return rows.select(*[F.col(c).alias(PARENT_PREFIX + c) for c in rows.columns])


def read_asset_allocation(view: DataFrame, positions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return read_reference(view, allocation_ids(positions), columns, "analytics_category_id")


def read_as_of(
    table: DataFrame,
    effective: str,
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
) -> DataFrame:
    """Rows of a versioned table valid at a moment; an open end is NULL."""
    moment = F.lit(effective).cast(table.schema[valid_from].dataType)
    return table.where((F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (moment < F.col(valid_to)))).drop(
        valid_from, valid_to
    )


def disjoint_versions(versions: DataFrame, columns: list[str]) -> DataFrame:
    """``_key, _from, _to`` and the columns, with one version at any moment of a key.

    Where versions overlap the one that began last holds, among those that began
    together the one that ends last, then the one with the greatest values. The
    starts and ends of a key's versions cut its time into pieces, each of which
    takes the best of the versions that cover it. Versions without a start never hold.
    """
    points = versions.select("_key", F.col("_from").alias("_p")).union(versions.where("_to IS NOT NULL").select("_key", "_to")).distinct()
    following = Window.partitionBy("_key").orderBy("_p")
    pieces = points.withColumn("_end", F.lead("_p").over(following)).withColumnRenamed("_key", "_piece_key")
    covers = (F.col("_from") <= F.col("_p")) & (F.col("_to").isNull() | (F.col("_p") < F.col("_to")))
    met = versions.join(pieces, (F.col("_key") == F.col("_piece_key")) & covers)
    later = F.struct("_from", F.col("_to").isNull().alias("_open"), F.col("_to").alias("_until"), F.to_json(F.struct(*columns)).alias("_values"))
    best = met.groupBy("_key", "_p", "_end").agg(F.max_by(F.struct(*columns), later).alias("_best"))
    return best.select("_key", F.col("_p").alias("_from"), F.col("_end").alias("_to"), *[F.col("_best")[c].alias(c) for c in columns])


def join_as_of(
    rows: DataFrame,
    table: DataFrame,
    columns: list[str],
    moment: str = MOMENT,
    key: str = "instrument_id",
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
) -> DataFrame:
    """Columns of the version of a table that is valid at each row's own moment.

    Rows without a moment get the version whose end is open. Where versions
    overlap a row still gets one of them (see ``disjoint_versions``).
    """
    taken = sorted(set(columns) & set(rows.columns))
    if taken:
        raise ValueError(f"columns {taken} are there already")
    versions = _needed(table, key, [*columns, valid_from, valid_to]).withColumnsRenamed(
        {key: "_key", valid_from: "_from", valid_to: "_to"}
    )
    versions = disjoint_versions(versions.where("_key IS NOT NULL AND _from IS NOT NULL"), columns)
    at = F.col(moment).cast(table.schema[valid_from].dataType)
    valid = F.when(at.isNull(), F.col("_to").isNull()).otherwise((F.col("_from") <= at) & (F.col("_to").isNull() | (at < F.col("_to"))))
    return rows.join(versions, (F.col(key) == F.col("_key")) & valid, "left").drop("_key", "_from", "_to")


def _joined(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    taken = sorted(set(table.columns) & set(rows.columns) - {key})
    if taken:
        raise ValueError(f"columns {taken} are there already: take them under other names or leave them out")
    return join_groups(rows, table, [key])


def join_instrument(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Columns by instrument; whether the table is broadcast is left to its size."""
    return _joined(rows, table, "instrument_id")


def join_parent_instrument(rows: DataFrame, parents: DataFrame) -> DataFrame:
    if "parent_instrument_id" not in rows.columns:
        return rows
    return _joined(rows, parents, "parent_instrument_id")


def join_asset_allocation(rows: DataFrame, view: DataFrame) -> DataFrame:
    if "asset_allocation_id" not in rows.columns:
        return rows
    renamed = view.withColumnRenamed("analytics_category_id", "asset_allocation_id")
    return _joined(rows, renamed, "asset_allocation_id")


@dataclass
class ReferenceTables:
    """Reference tables by role, with the columns to take (None: all)."""

    instrument: dict[str, tuple[DataFrame, list[str] | None]] = field(default_factory=dict)
    """Tables keyed by ``instrument_id``, by name."""
    parent_instrument: tuple[DataFrame, list[str] | None] | None = None
    asset_allocation: tuple[DataFrame, list[str] | None] | None = None
    versioned: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    """Tables with ``valid_from`` and ``valid_to``, by name: each request gets the version of its own date."""


def attach_reference(
    positions: DataFrame, lookthroughs: DataFrame | None, reference: ReferenceTables
) -> tuple[DataFrame, DataFrame | None]:
    """Left joins of all reference tables, after the missing values were filled.

    Parents and allocations are looked up for the ids of the positions only, so
    a child whose parent id no position has gets NULL.
    """
    original, children = positions, lookthroughs
    for table, columns in reference.instrument.values():
        rows = _needed(table, "instrument_id", columns)
        positions = join_instrument(positions, rows)
        if lookthroughs is not None:
            lookthroughs = join_instrument(lookthroughs, rows)
    if reference.parent_instrument is not None and has(original, "parent_instrument_id"):
        table, columns = reference.parent_instrument
        rows = read_parent_reference(table, original, columns)
        positions = join_parent_instrument(positions, rows)
        if has(children, "parent_instrument_id"):
            lookthroughs = join_parent_instrument(lookthroughs, rows)
    if reference.asset_allocation is not None and has(original, "asset_allocation_id"):
        table, columns = reference.asset_allocation
        rows = read_asset_allocation(table, original, columns)
        positions = join_asset_allocation(positions, rows)
        if has(children, "asset_allocation_id"):
            lookthroughs = join_asset_allocation(lookthroughs, rows)
    for table, columns in reference.versioned.values():
        if not has(original, MOMENT):
            raise ValueError("versioned tables need the date of each row's request")
        positions = join_as_of(positions, table, columns)
        if lookthroughs is not None:
            lookthroughs = join_as_of(lookthroughs, table, columns)
    return positions, lookthroughs
