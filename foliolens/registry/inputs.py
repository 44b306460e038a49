"""Input tables of the registered queries, and the same tables as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliolens import datasets
from foliolens.model import Labels, Modifier, RuleBook, ViewSet, custom_rules
from foliolens.operators.normalize import normalize
from foliolens.schema import LOOKTHROUGHS, POSITIONS

ALL_LABELS = [*datasets.POSITION_LABELS, "weight"]


def positions(spark: SparkSession, folder: str, spread: int | None = None) -> DataFrame:
    return normalize(datasets.positions(spark, folder, spread), ALL_LABELS, POSITIONS)


def lookthroughs(spark: SparkSession, folder: str, spread: int | None = None) -> DataFrame:
    return normalize(datasets.lookthroughs(spark, folder, spread), ALL_LABELS, LOOKTHROUGHS)


def view_set(
    configs: dict,
    rules: dict | None = None,
    labels: Labels | None = None,
    book: RuleBook | None = None,
    modifiers: dict[str, Modifier] | None = None,
    defaults: list[str] | None = None,
) -> ViewSet:
    """Views over the input tables; without default modifiers unless asked for."""
    known = custom_rules(rules)
    return ViewSet.build(
        configs,
        labels or datasets.LABELS,
        book=known.over(book) if book else known,
        modifiers=modifiers,
        defaults=[] if defaults is None else defaults,
    )


def rule(criteria: dict, apply_to: str = "both", link: str | None = None, percent: float | None = None) -> dict:
    definition = {"criteria": criteria, "apply_to": apply_to, "condition_for_next_rule": link}
    if percent is not None:
        definition |= {"is_scaling_rule": True, "scale_factor": percent}
    return definition


def test(column: str, kind: str, value=None) -> dict:
    return {"column": column, "operator_type": kind, "value": value}


# The same tables in SQL: raw_pos / raw_lt as delivered, pos / lt normalised.
RAW = """
raw_pos AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'holding' WHEN 'O' THEN 'selected_reference'
              ELSE 'contractual_reference' END AS container,
         'positions' AS record_type, CAST(o_orderkey AS VARCHAR) AS identifier,
         o_orderkey AS instrument_id, o_custkey AS parent_instrument_id, o_custkey % 10 AS sub_portfolio_id,
         ROUND(o_totalprice * 100) / 1048576 AS initial_weight,
         (ROUND(o_totalprice * 100) + o_orderkey % 7 * 4096) / 1048576 AS resulting_weight,
         ROUND(o_totalprice * 100) / 2097152 AS initial_exposure_weight,
         (ROUND(o_totalprice * 100) + o_orderkey % 5 * 4096) / 2097152 AS resulting_exposure_weight,
         CASE WHEN o_orderstatus <> 'F' THEN ROUND(o_totalprice * 100) / 4194304 END AS weight,
         o_orderkey % 11 AS initial_shares, NULLIF(o_orderkey % 13, 0) AS resulting_shares,
         CAST(o_orderpriority[1] AS BIGINT) AS trade_type_id,
         NULLIF(o_orderkey % 9, 0) AS liquidity_type_id, o_orderkey % 7 + 6 AS position_source_type_id,
         NULLIF(o_orderkey % 40, 0) AS simulated_trade_id, NULLIF(-(o_orderkey % 4), 0) AS perspective_id,
         NULLIF(o_orderkey % 6, 5) AS red_flag_exclusion_type_id,
         NULLIF(o_orderkey % 8, 3) AS position_blocking_type_id,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 3 = 1 END AS is_class_position,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 5 < 3 END AS upcoming_trade_date,
         o_custkey % 25 AS asset_allocation_id,
         CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS priority
  FROM orders),
raw_lt AS (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'holding' WHEN 'O' THEN 'selected_reference'
              ELSE 'contractual_reference' END AS container,
         CASE WHEN l_returnflag = 'N' THEN 'essential_lookthroughs' ELSE 'complete_lookthroughs' END AS record_type,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS identifier,
         l_partkey AS instrument_id, l_orderkey AS parent_instrument_id, o_custkey % 10 AS sub_portfolio_id,
         ROUND(l_extendedprice * 100) / 1048576 AS initial_weight,
         (ROUND(l_extendedprice * 100) + l_partkey % 7 * 4096) / 1048576 AS resulting_weight,
         ROUND(l_extendedprice * 100) / 2097152 AS initial_exposure_weight,
         (ROUND(l_extendedprice * 100) + l_partkey % 5 * 4096) / 2097152 AS resulting_exposure_weight,
         l_quantity / 64 AS weight,
         l_partkey % 5 + 1 AS trade_type_id, NULLIF((l_partkey + l_linenumber) % 9, 0) AS liquidity_type_id,
         (l_partkey + l_linenumber) % 7 + 6 AS position_source_type_id,
         NULLIF(l_partkey % 40, 0) AS simulated_trade_id, NULLIF(-(l_partkey % 4), 0) AS perspective_id,
         NULLIF(l_partkey % 6, 5) AS red_flag_exclusion_type_id,
         NULLIF(l_partkey % 8, 3) AS position_blocking_type_id,
         CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 3 = 1 END AS is_class_position,
         CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 5 < 3 END AS upcoming_trade_date,
         l_partkey % 25 AS asset_allocation_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FILLED = [
    "parent_instrument_id",
    "liquidity_type_id",
    "simulated_trade_id",
    "perspective_id",
    "red_flag_exclusion_type_id",
    "position_blocking_type_id",
]


def _filled(*columns: str) -> str:
    return ", ".join(f"COALESCE({c}, -2147483648) AS {c}" for c in columns)


NORMALISED = (
    RAW
    + f""",
pos AS (SELECT * REPLACE ({_filled(*FILLED, 'resulting_shares')}) FROM raw_pos),
lt AS (SELECT * REPLACE ({_filled(*FILLED)}) FROM raw_lt)"""
)

INSTRUMENTS = """
instruments AS (SELECT p_partkey AS instrument_id, p_size * 2 AS instrument_subtype_id, p_type AS instrument_type,
                       p_brand AS brand FROM part)"""

ALLOCATIONS = """
allocations AS (SELECT CAST(n_nationkey AS BIGINT) AS analytics_category_id, n_name AS category_name,
                       r_name AS category_group FROM nation JOIN region ON n_regionkey = r_regionkey)"""

CATEGORIES = """
categories AS (
  SELECT c_custkey AS instrument_id, (c_custkey + n) % 12 AS category_id, c_mktsegment AS segment, valid_from, valid_to
  FROM customer CROSS JOIN (VALUES ('1990-01-01', '1997-01-01', 0), ('1997-01-01', '2001-01-01', 1),
                                   ('2001-01-01', NULL, 2)) AS v(valid_from, valid_to, n))"""


def with_tables(body: str, *ctes: str) -> str:
    """A query over the normalised tables and further CTEs."""
    return "WITH " + ",".join([NORMALISED, *ctes]) + "\n" + body
