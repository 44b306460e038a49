"""Catalogue questions, step attribution and the request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens import datasets
from foliolens.model import Modifier
from foliolens.operators.audit import attributed_rows, balance, removed_samples, step_attribution, waterfall
from foliolens.operators.catalog import custom_rule_columns, nested_criteria_report, required_columns, rule_columns
from foliolens.plans.modifiers import DEFAULT_MODIFIERS, MODIFIERS
from foliolens.plans.reuse import new_folder, settings
from foliolens.registry.inputs import lookthroughs, positions, rule, test, view_set, with_tables
from foliolens.registry.output_queries import document_weights, documents_sql
from foliolens.registry.source_queries import stored_perspectives
from foliolens.plans.pipeline import run_views
from foliolens.registry.view_queries import HOLD, KEEP_TRADE

NAMES = ["exclude_blocked_positions", "exclude_future_trades", "scale_lookthroughs_to_100_percent",
         "exclude_other_net_assets_excl_investment_grade_accrual"]


def requested_views(spark, folder) -> DataFrame:
    """Views that requests ask for: one request per customer."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return datasets.table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("request_id"),
        F.lit("main").alias("config"),
        (F.col("c_custkey") % 60).alias("perspective_id"),
        F.when(F.col("c_custkey") % 5 != 0, F.element_at(names, (F.col("c_custkey") % 4 + 1).cast("int"))).alias("modifier"),
    )


def _required(spark, folder):
    rules = rule_columns(stored_perspectives(spark, folder))
    return required_columns(requested_views(spark, folder), rules, MODIFIERS, DEFAULT_MODIFIERS)


NEEDS = [
    (0, "position_data", "position_blocking_type_id"),
    (1, "position_data", "trade_type_id"),
    (1, "position_data", "upcoming_trade_date"),
    (2, "instrument", "instrument_subtype_id"),
    (3, "position_data", "liquidity_type_id"),
    (3, "position_data", "parent_instrument_id"),
    (3, "parent_instrument", "instrument_subtype_id"),
]
REQUIRED_SQL = f"""WITH q AS (SELECT c_custkey AS k, 'c' || c_custkey AS request_id, c_custkey % 60 AS pid FROM customer),
usable AS (SELECT p_size FROM part GROUP BY p_size HAVING bool_and(p_partkey % 97 <> 0)),
needed AS (
  SELECT p_size AS pid, 'instrument' AS t, UNNEST(['brand', 'p_' || lower(p_type)]) AS c FROM part
  UNION SELECT p_size, 'parent_instrument', 'name' || (p_size % 3) FROM part
  UNION SELECT p_size, 'position_data', UNNEST(['parent_instrument_id', 'weight']) FROM part),
mods AS (SELECT * FROM (VALUES {', '.join(str(n) for n in NEEDS)}) AS v(m, t, c))
SELECT request_id, t AS "table", c AS "column" FROM q JOIN needed USING (pid) WHERE pid IN (SELECT p_size FROM usable)
UNION SELECT request_id, t, c FROM q JOIN mods ON k % 4 = m WHERE k % 5 <> 0
UNION SELECT request_id, 'position_data', UNNEST(['position_source_type_id', 'liquidity_type_id', 'perspective_id', 'sub_portfolio_id']) FROM q"""



def _required_by_custom_rules(spark, folder):
    """Requests that bring rules of their own: those of the perspectives they ask for count."""
    rule_text = (
        '{"rules":[{"apply_to":"both","criteria":{"column":"weight","operator_type":">","value":0,"required_columns":%s}}]}'
    )
    first = rule_text % '{"Instrument":["Col_%d","brand"],"position_data":["weight"]}'
    second = rule_text % '{"asset_allocation_analytics_category_v":["analytics_category_id"]}'
    sent = '{"custom_perspective_rules":{"-1":%s,"-2":%s}}' % (first, second)
    requests = datasets.table(spark, folder, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("request_id"),
        F.lit("main").alias("config"),
        (-(F.col("c_custkey") % 3)).cast("long").alias("perspective_id"),
        F.lit(None).cast("string").alias("modifier"),
        F.format_string(sent, (F.col("c_custkey") % 7).cast("int")).alias("request"),
    )
    rules = rule_columns(stored_perspectives(spark, folder))
    return required_columns(requests, rules, MODIFIERS, [], custom_rule_columns(requests))


QUERIES = {
    "C-01_custom_rules": (
        _required_by_custom_rules,
        """SELECT 'c' || c_custkey AS request_id, 'position_data' AS "table", 'sub_portfolio_id' AS "column" FROM customer
UNION SELECT 'c' || c_custkey, 'instrument', UNNEST(['col_' || (c_custkey % 7), 'brand']) FROM customer WHERE c_custkey % 3 = 1
UNION SELECT 'c' || c_custkey, 'position_data', 'weight' FROM customer WHERE c_custkey % 3 = 1
UNION SELECT 'c' || c_custkey, 'position_data', 'asset_allocation_id' FROM customer WHERE c_custkey % 3 = 2""",
    ),
    "C-01_required_columns": (_required, REQUIRED_SQL),
    "C-02_nested_criteria_report": (
        lambda spark, folder: nested_criteria_report(stored_perspectives(spark, folder)).select(
            "perspective_id", "ordinal", "path", "outer_column", "operator_type",
            F.get_json_object("inner_criteria", "$.table_name").alias("inner_table"),
        ),
        """SELECT CAST(p_size AS BIGINT) AS perspective_id, p_partkey AS ordinal, 'or.0.not.0' AS path,
  'instrument_id' AS outer_column, 'NotIn' AS operator_type, 'T' || (p_size % 5) AS inner_table FROM part
WHERE p_size IN (SELECT p_size FROM part GROUP BY p_size HAVING bool_and(p_partkey % 97 <> 0))""",
    ),
}

AUDIT_MODIFIERS = {
    "pre_liquidity": Modifier("pre_liquidity", "PreProcessing", test("liquidity_type_id", "==", 2)),
    "pre_source": Modifier("pre_source", "PreProcessing", test("position_source_type_id", "==", 8), "holding"),
    "save": Modifier("save", "PostProcessing", test("liquidity_type_id", "==", 7), "both", "or"),
    "restrict": Modifier("restrict", "PostProcessing", test("position_source_type_id", "!=", 12), "both", "and"),
}
AUDIT_RULES = {
    "-1": {"rules": [KEEP_TRADE, rule(test("liquidity_type_id", "!=", 5))]},
    "-2": {"rules": [rule(test("trade_type_id", "==", 1), link="or"), rule(test("liquidity_type_id", ">", 3))]},
}


def audit_views(*more: str):
    names = ["pre_liquidity", "pre_source", "save", "restrict", *more]
    return view_set({"main": {"-1": names, "-2": ["pre_liquidity"]}}, AUDIT_RULES, modifiers=AUDIT_MODIFIERS)


AUDITED = f"""
steps AS (
  SELECT record_type, container, identifier, instrument_id, parent_instrument_id, sub_portfolio_id, initial_weight,
    -1 AS pid, CASE WHEN liquidity_type_id = 2 THEN 'pre_liquidity'
      WHEN container = 'holding' AND position_source_type_id = 8 THEN 'pre_source'
      WHEN position_source_type_id = 12 AND ((trade_type_id IN (1, 2) AND liquidity_type_id <> 5) OR liquidity_type_id = 7)
        THEN 'restrict'
      WHEN (trade_type_id IN (1, 2) AND liquidity_type_id <> 5) OR liquidity_type_id = 7 THEN 'output'
      WHEN trade_type_id NOT IN (1, 2) THEN 'rule_0' ELSE 'rule_1' END AS own,
    CASE WHEN trade_type_id NOT IN (1, 2) OR liquidity_type_id = 5 THEN 'save' END AS saved
  FROM (SELECT * EXCLUDE (initial_shares, resulting_shares, priority) FROM pos UNION ALL BY NAME SELECT * FROM lt)
  UNION ALL
  SELECT record_type, container, identifier, instrument_id, parent_instrument_id, sub_portfolio_id, initial_weight,
    -2, CASE WHEN liquidity_type_id = 2 THEN 'pre_liquidity'
      WHEN trade_type_id = 1 OR liquidity_type_id > 3 THEN 'output' ELSE 'rule_0' END,
    CASE WHEN trade_type_id <> 1 THEN 'rule_1' END
  FROM (SELECT * EXCLUDE (initial_shares, resulting_shares, priority) FROM pos UNION ALL BY NAME SELECT * FROM lt)),
alive AS (SELECT DISTINCT pid, container, instrument_id, sub_portfolio_id FROM steps
          WHERE record_type = 'positions' AND own = 'output'),
audited AS (
  SELECT s.*, CASE WHEN own = 'output' AND record_type <> 'positions' AND a.pid IS NULL THEN 'parent_removed' ELSE own END AS step
  FROM steps s LEFT JOIN alive a ON a.pid = s.pid AND a.container = s.container
    AND a.instrument_id = s.parent_instrument_id AND a.sub_portfolio_id = s.sub_portfolio_id)"""


def _attribution(spark, folder):
    rows = step_attribution(positions(spark, folder), lookthroughs(spark, folder), audit_views())
    return rows.select("perspective_id", "container", "record_type", "identifier", "instrument_id", "step")


def _attributed(spark, folder):
    return attributed_rows(positions(spark, folder), lookthroughs(spark, folder), audit_views(), ["initial_weight"])


QUERIES["AU-01_step_attribution"] = (
    _attribution,
    with_tables(
        "SELECT pid AS perspective_id, container, record_type, identifier, instrument_id, step FROM audited WHERE step <> 'output'",
        AUDITED,
    ),
)
QUERIES["AU-02_waterfall"] = (
    lambda spark, folder: waterfall(_attributed(spark, folder), ["initial_weight"]).drop("request_id", "config"),
    with_tables(
        """SELECT pid AS perspective_id, step, container, record_type, COUNT(*) AS rows, SUM(initial_weight) AS initial_weight
FROM audited GROUP BY ALL""",
        AUDITED,
    ),
)


def _balance(spark, folder):
    """What came in, was removed, saved and left, with the scale factors of what is left."""
    pos, lt, vs = positions(spark, folder), lookthroughs(spark, folder), audit_views(HOLD)
    report = balance(attributed_rows(pos, lt, vs, ["initial_weight"]), ["initial_weight"], run_views(pos, lt, vs).all_scale_factors)
    return report.select(
        "perspective_id", "container", "record_type", "kind", "step", "rows", "initial_weight",
        F.round(F.col("scale_factors")["initial_weight"], 9).alias("scale_factor"),
    )


BALANCED = """
lines AS (
  SELECT *, 'input' AS kind, NULL AS named FROM audited
  UNION ALL SELECT *, 'output', NULL FROM audited WHERE step = 'output'
  UNION ALL SELECT *, 'removed', step FROM audited WHERE step <> 'output'
  UNION ALL SELECT *, 'saved', saved FROM audited WHERE step = 'output' AND saved IS NOT NULL),
scale AS (
  SELECT pid, SUM(initial_weight) FILTER (step = 'output') / SUM(initial_weight) AS share FROM audited
  WHERE container = 'holding' AND record_type IN ('positions', 'essential_lookthroughs') GROUP BY pid)"""
QUERIES["AU-02_balance"] = (
    _balance,
    with_tables(
        """SELECT pid AS perspective_id, container, record_type, kind, named AS step, COUNT(*) AS rows, SUM(initial_weight) AS initial_weight,
  CASE WHEN kind = 'output' AND container = 'holding' THEN CASE WHEN pid = -1 THEN ROUND(ANY_VALUE(share), 9) ELSE 1.0 END END AS scale_factor
FROM lines JOIN scale USING (pid) GROUP BY pid, container, record_type, kind, named""",
        AUDITED,
        BALANCED,
    ),
)
QUERIES["AU-03_removed_samples"] = (
    lambda spark, folder: removed_samples(_attributed(spark, folder), 3, "initial_weight").drop("request_id", "config"),
    with_tables(
        """SELECT pid AS perspective_id, step, container, record_type, rank, identifier, initial_weight, GREATEST(n - 3, 0) AS more
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY pid, step, container, record_type
        ORDER BY initial_weight DESC, identifier, instrument_id) AS rank,
        COUNT(*) OVER (PARTITION BY pid, step, container, record_type) AS n
      FROM audited WHERE step <> 'output') WHERE rank <= 3""",
        AUDITED,
    ),
)


def _stream(spark, folder):
    """Requests as files, processed by the stream; the responses are read back."""
    from foliolens.registry.source_queries import TYPES, json_requests
    from foliolens.sources.requests import READING, read_request_stream
    from foliolens.streaming.requests import process_stream

    work = new_folder(spark)
    requests = json_requests(spark, folder)
    with_id = F.concat(F.lit('{"request_id":"'), F.col("request_id"), F.lit('",'), F.expr("substring(request, 2)"))
    with settings(spark, READING):
        requests.select(with_id.alias("value")).write.mode("overwrite").option("compression", "gzip").text(f"{work}/in")
    stream = read_request_stream(spark, f"{work}/in")
    process_stream(stream, f"{work}/out", f"{work}/state", available_now=True, types=TYPES, defaults=[]).awaitTermination()
    return document_weights(spark.read.parquet(f"{work}/out"))


QUERIES["S-10_read_request_stream"] = (_stream, documents_sql())
