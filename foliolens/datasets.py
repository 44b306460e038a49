"""The benchmark tables as positions, lookthroughs and reference tables.

Weights are whole cents divided by powers of two: sums of them are exact in
doubles, so results do not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliolens.schema import COMPLETE, CONTRACTUAL, ESSENTIAL, HOLDING, SELECTED
from foliolens.sources.tables import read_table

POSITION_LABELS = ["initial_weight", "resulting_weight", "initial_exposure_weight", "resulting_exposure_weight"]
LABELS = {
    HOLDING: (POSITION_LABELS, ["weight"]),
    SELECTED: (["weight"], ["weight"]),
    CONTRACTUAL: (["weight"], ["weight"]),
}


# Columns in use, so that no job has to look the types up.
COLUMNS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, folder: str, name: str, spread: int | None = None) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet", schema=COLUMNS[name], spread=spread)


BLOCK = "_block"
Block = Callable[[Column], Column]
"""What rows are dealt by, from their order key."""


def _dealt(rows: DataFrame, key: str, block: Block | None) -> DataFrame:
    """Rows with their block, all rows of a block in one task."""
    return rows if block is None else rows.withColumn(BLOCK, block(F.col(key))).repartition(BLOCK)


CONTAINER = f"""CASE o_orderstatus WHEN 'F' THEN '{HOLDING}' WHEN 'O' THEN '{SELECTED}' ELSE '{CONTRACTUAL}' END"""


def positions(spark: SparkSession, folder: str, spread: int | None = None, block: Block | None = None) -> DataFrame:
    """One position per order, with its block where rows are dealt by one."""
    cents = "round(o_totalprice * 100)"
    return _dealt(table(spark, folder, "orders", spread), "o_orderkey", block).selectExpr(
        f"{CONTAINER} AS container",
        "'positions' AS record_type",
        "string(o_orderkey) AS identifier",
        "o_orderkey AS instrument_id",
        "o_custkey AS parent_instrument_id",
        "o_custkey % 10 AS sub_portfolio_id",
        f"{cents} / 1048576 AS initial_weight",
        f"({cents} + o_orderkey % 7 * 4096) / 1048576 AS resulting_weight",
        f"{cents} / 2097152 AS initial_exposure_weight",
        f"({cents} + o_orderkey % 5 * 4096) / 2097152 AS resulting_exposure_weight",
        f"CASE WHEN o_orderstatus <> 'F' THEN {cents} / 4194304 END AS weight",
        "o_orderkey % 11 AS initial_shares",
        "nullif(o_orderkey % 13, 0) AS resulting_shares",
        "bigint(substring(o_orderpriority, 1, 1)) AS trade_type_id",
        "nullif(o_orderkey % 9, 0) AS liquidity_type_id",
        "o_orderkey % 7 + 6 AS position_source_type_id",
        "nullif(o_orderkey % 40, 0) AS simulated_trade_id",
        "nullif(-(o_orderkey % 4), 0) AS perspective_id",
        "nullif(o_orderkey % 6, 5) AS red_flag_exclusion_type_id",
        "nullif(o_orderkey % 8, 3) AS position_blocking_type_id",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END AS is_class_position",
        "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 < 3 END AS upcoming_trade_date",
        "o_custkey % 25 AS asset_allocation_id",
        "CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS priority",
        *([] if block is None else [BLOCK]),
    )


def lookthroughs(spark: SparkSession, folder: str, spread: int | None = None, block: Block | None = None) -> DataFrame:
    """One child row per order line, with the container of its order and its block where rows are dealt by one.

    Lines and orders are dealt before they meet, so their block costs no further move.
    """
    cents = "round(l_extendedprice * 100)"
    orders = table(spark, folder, "orders").selectExpr("o_orderkey AS l_orderkey", "o_orderstatus", "o_custkey")
    own = [] if block is None else [BLOCK]
    return (
        _dealt(table(spark, folder, "lineitem", spread), "l_orderkey", block)
        .join(_dealt(orders, "l_orderkey", block), ["l_orderkey", *own])
        .selectExpr(
            f"{CONTAINER} AS container",
            f"CASE l_returnflag WHEN 'N' THEN '{ESSENTIAL}' ELSE '{COMPLETE}' END AS record_type",
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS identifier",
            "l_partkey AS instrument_id",
            "l_orderkey AS parent_instrument_id",
            "o_custkey % 10 AS sub_portfolio_id",
            f"{cents} / 1048576 AS initial_weight",
            f"({cents} + l_partkey % 7 * 4096) / 1048576 AS resulting_weight",
            f"{cents} / 2097152 AS initial_exposure_weight",
            f"({cents} + l_partkey % 5 * 4096) / 2097152 AS resulting_exposure_weight",
            "l_quantity / 64 AS weight",
            "l_partkey % 5 + 1 AS trade_type_id",
            "nullif((l_partkey + l_linenumber) % 9, 0) AS liquidity_type_id",
            "(l_partkey + l_linenumber) % 7 + 6 AS position_source_type_id",
            "nullif(l_partkey % 40, 0) AS simulated_trade_id",
            "nullif(-(l_partkey % 4), 0) AS perspective_id",
            "nullif(l_partkey % 6, 5) AS red_flag_exclusion_type_id",
            "nullif(l_partkey % 8, 3) AS position_blocking_type_id",
            "CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 = 1 END AS is_class_position",
            "CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 5 < 3 END AS upcoming_trade_date",
            "l_partkey % 25 AS asset_allocation_id",
            *own,
        )
    )


def instruments(spark: SparkSession, folder: str) -> DataFrame:
    """Instrument reference: one row per part."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("instrument_id"),
        (F.col("p_size") * 2).alias("instrument_subtype_id"),
        F.col("p_type").alias("instrument_type"),
        F.col("p_brand").alias("brand"),
    )


def categorization(spark: SparkSession, folder: str) -> DataFrame:
    """Versioned categories: three consecutive periods per customer."""
    versions = """inline(array(
        named_struct('valid_from', '1990-01-01', 'valid_to', '1997-01-01', 'n', 0),
        named_struct('valid_from', '1997-01-01', 'valid_to', '2001-01-01', 'n', 1),
        named_struct('valid_from', '2001-01-01', 'valid_to', string(NULL), 'n', 2)))"""
    return (
        table(spark, folder, "customer")
        .selectExpr("c_custkey AS instrument_id", "c_mktsegment AS segment", versions)
        .selectExpr("instrument_id", "(instrument_id + n) % 12 AS category_id", "segment", "valid_from", "valid_to")
    )


def allocation_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Asset allocation view: one row per nation with its region."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("analytics_category_id"),
        F.col("n_name").alias("category_name"),
        F.col("r_name").alias("category_group"),
    )
