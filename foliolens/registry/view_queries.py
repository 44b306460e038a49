"""Views over the whole tables: rules, modifiers, lookthroughs, rescaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens import datasets
from foliolens.operators.factors import bit, evaluate, factors, with_group_flags
from foliolens.operators.lookthrough import expand_lookthroughs, parent_masks, sync_factor_rows, sync_lookthroughs
from foliolens.operators.reference import ReferenceTables, attach_reference
from foliolens.operators.rescale import group_masses, matching_parents, raw_totals, with_container_totals
from foliolens.operators.scale_factors import scale_factors_from_result
from foliolens.model import Modifier
from foliolens.operators.skew import join_groups
from foliolens.plans.modifiers import DEFAULT_MODIFIERS
from foliolens.plans.pipeline import run_views
from foliolens.registry.inputs import (
    ALL_LABELS,
    INSTRUMENTS,
    lookthroughs,
    positions,
    rule,
    test,
    view_set,
    with_tables,
)
from foliolens.schema import ESSENTIAL, out

HOLD, LOOK = "scale_holdings_to_100_percent", "scale_lookthroughs_to_100_percent"
SUM_LABELS = ["initial_weight", "resulting_weight", "weight"]

CRITERIA_RULES = {
    "-1": {"rules": [rule(test("trade_type_id", "<=", 4)), rule(test("liquidity_type_id", ">", 5), percent=50)]},
    "-2": {
        "rules": [
            rule(test("trade_type_id", "In", [1, 2, 5]), link="or"),
            rule(test("liquidity_type_id", "Between", [2, 4])),
            rule(test("is_class_position", "==", True), percent=25),
        ]
    },
    "-3": {"rules": [rule(test("position_source_type_id", "!=", 8), "holding")]},
}
# The same three views in SQL: (id, keep, factor).
VIEWS_SQL = [
    (-1, "trade_type_id <= 4", "CASE WHEN liquidity_type_id > 5 THEN 0.5 ELSE 1.0 END"),
    (
        -2,
        "(trade_type_id IN (1, 2, 5) OR liquidity_type_id BETWEEN 2 AND 4)",
        "CASE WHEN COALESCE(is_class_position, FALSE) THEN 0.25 ELSE 1.0 END",
    ),
    (-3, "(container <> 'holding' OR position_source_type_id <> 8)", "1.0"),
]


def views(*modifiers: str):
    return view_set({"main": {pid: list(modifiers) for pid in CRITERIA_RULES}}, CRITERIA_RULES)


KEPT = (
    "kp AS ("
    + " UNION ALL ".join(
        f"SELECT *, {pid} AS pid, CAST({factor} AS DOUBLE) AS factor FROM pos WHERE {keep}"
        for pid, keep, factor in VIEWS_SQL
    )
    + "), own_lt AS ("
    + " UNION ALL ".join(
        f"SELECT *, {pid} AS pid, CAST({factor} AS DOUBLE) AS factor FROM lt WHERE {keep}"
        for pid, keep, factor in VIEWS_SQL
    )
    + """), parents AS (SELECT DISTINCT pid, container, instrument_id, sub_portfolio_id FROM kp),
kl AS (SELECT c.* FROM own_lt c JOIN parents p ON p.pid = c.pid AND p.container = c.container
       AND p.instrument_id = c.parent_instrument_id AND p.sub_portfolio_id = c.sub_portfolio_id)"""
)
MASSES = """
mass AS (SELECT pid, container, SUM(initial_weight * factor) AS iw, SUM(resulting_weight * factor) AS rw,
                SUM(initial_exposure_weight * factor) AS iew, SUM(resulting_exposure_weight * factor) AS rew,
                COALESCE(SUM(weight * factor), 0) AS w
         FROM (SELECT pid, container, initial_weight, resulting_weight, initial_exposure_weight,
                      resulting_exposure_weight, weight, factor FROM kp
               UNION ALL SELECT pid, container, initial_weight, resulting_weight, initial_exposure_weight,
                      resulting_exposure_weight, weight, factor FROM kl
               WHERE record_type = 'essential_lookthroughs') GROUP BY pid, container)"""
TOTALS = """
tot AS (SELECT container, SUM(initial_weight) AS iw, SUM(resulting_weight) AS rw,
               SUM(initial_exposure_weight) AS iew, SUM(resulting_exposure_weight) AS rew, COALESCE(SUM(weight), 0) AS w
        FROM (SELECT container, initial_weight, resulting_weight, initial_exposure_weight,
                     resulting_exposure_weight, weight FROM pos
              UNION ALL SELECT container, initial_weight, resulting_weight, initial_exposure_weight,
                     resulting_exposure_weight, weight FROM lt
              WHERE record_type = 'essential_lookthroughs') GROUP BY container)"""
SHORT = {
    "initial_weight": "iw",
    "resulting_weight": "rw",
    "initial_exposure_weight": "iew",
    "resulting_exposure_weight": "rew",
    "weight": "w",
}


def main(spark, folder, *modifiers: str):
    return run_views(positions(spark, folder), lookthroughs(spark, folder), views(*modifiers))


def kept_summary(rows: DataFrame) -> DataFrame:
    """Kept rows and mass per view, section and sub-portfolio."""
    return rows.groupBy("config", "perspective_id", "container", "record_type", "sub_portfolio_id").agg(
        F.count(F.lit(1)).alias("kept"),
        F.sum("instrument_id").alias("instruments"),
        F.sum(F.col("initial_weight") * F.col("factor")).alias("mass"),
    )


def kept_sql(body: str, config: str = "main") -> str:
    return f"""SELECT '{config}' AS config, pid AS perspective_id, container, record_type, sub_portfolio_id,
  COUNT(*) AS kept, CAST(SUM(instrument_id) AS BIGINT) AS instruments, SUM(initial_weight * factor) AS mass
FROM ({body}) GROUP BY pid, container, record_type, sub_portfolio_id"""


def both(result) -> DataFrame:
    return result.positions.unionByName(result.lookthroughs, allowMissingColumns=True)


# --- rules, scopes, saviours -------------------------------------------------


def _rules(rules: list[dict], names: list[str] | None = None, modifiers: dict[str, Modifier] | None = None):
    """Kept rows of one view with the given rules and modifiers."""

    def run(spark, folder):
        vs = view_set({"main": {"-1": names or []}}, {"-1": {"rules": rules}}, modifiers=modifiers)
        return kept_summary(both(run_views(positions(spark, folder), lookthroughs(spark, folder), vs)))

    return run


def one_view_sql(keep: str, factor: str = "1.0", lookthrough_keep: str | None = None, *ctes: str) -> str:
    """Kept positions and children of one view; ``keep`` holds on both tables."""
    own = lookthrough_keep or keep
    kept = f"""k1 AS (SELECT *, -1 AS pid, CAST({factor} AS DOUBLE) AS factor FROM pos WHERE {keep}),
k2 AS (SELECT c.*, -1 AS pid, CAST({factor} AS DOUBLE) AS factor FROM lt c WHERE {own} AND EXISTS (
  SELECT 1 FROM k1 p WHERE p.container = c.container AND p.instrument_id = c.parent_instrument_id
  AND p.sub_portfolio_id = c.sub_portfolio_id))"""
    columns = "pid, container, record_type, sub_portfolio_id, instrument_id, initial_weight, factor"
    return with_tables(kept_sql(f"SELECT {columns} FROM k1 UNION ALL SELECT {columns} FROM k2"), *ctes, kept)


def _pre(criteria: dict, apply_to: str = "both") -> dict[str, Modifier]:
    return {"m": Modifier("m", "PreProcessing", criteria, apply_to)}


def _post(criteria: dict, operator: str, apply_to: str = "both") -> dict[str, Modifier]:
    return {"m": Modifier("m", "PostProcessing", criteria, apply_to, operator)}


KEEP_TRADE = rule(test("trade_type_id", "In", [1, 2]))
TRADE_SQL = "trade_type_id IN (1, 2)"
GROUP_IN = test("simulated_trade_id", "In", {"table_name": "rule_result", "column": "result", "operator_type": "==", "value": True})
GROUP_NOT_IN = {**GROUP_IN, "operator_type": "NotIn"}


def _group_sql(negate: bool) -> str:
    passing = {t: f"(SELECT simulated_trade_id FROM {t} WHERE trade_type_id IN (1, 2) AND liquidity_type_id <> 2)" for t in ("pos", "lt")}
    conditions = {
        t: f"liquidity_type_id <> 2 AND (trade_type_id IN (1, 2) OR simulated_trade_id {'NOT ' if negate else ''}IN {p})"
        for t, p in passing.items()
    }
    return one_view_sql(conditions["pos"], "1.0", conditions["lt"])


GROUP_MODIFIERS = {
    "m": Modifier("m", "PostProcessing", GROUP_IN, "both", "or"),
    "n": Modifier("n", "PostProcessing", GROUP_NOT_IN, "both", "or"),
    "pre": Modifier("pre", "PreProcessing", test("liquidity_type_id", "==", 2)),
}

QUERIES = {
    "F-02_preprocess_exclude": (
        _rules([KEEP_TRADE], ["m"], _pre(test("liquidity_type_id", "==", 3), "reference")),
        one_view_sql(f"{TRADE_SQL} AND NOT (container <> 'holding' AND liquidity_type_id = 3)"),
    ),
    "F-03_rule_chain": (
        _rules(
            [
                rule(test("trade_type_id", "In", [1, 2]), link="and"),
                rule(test("liquidity_type_id", ">", 6), percent=50, link="or"),
                rule(test("liquidity_type_id", "==", 4), link="and"),
                rule(test("position_source_type_id", "!=", 7), "reference"),
            ]
        ),
        one_view_sql(
            "((trade_type_id IN (1, 2) OR liquidity_type_id = 4) AND (container = 'holding' OR position_source_type_id <> 7))",
            "CASE WHEN liquidity_type_id > 6 THEN 0.5 ELSE 1.0 END",
        ),
    ),
    "F-04_postprocess_or": (
        _rules([KEEP_TRADE], ["m"], _post(test("liquidity_type_id", "==", 3), "or", "holding")),
        one_view_sql(f"({TRADE_SQL} OR (container = 'holding' AND liquidity_type_id = 3))"),
    ),
    "F-05_postprocess_and": (
        _rules([KEEP_TRADE], ["m"], _post(test("liquidity_type_id", "<", 6), "and", "reference")),
        one_view_sql(f"({TRADE_SQL} AND (container = 'holding' OR liquidity_type_id < 6))"),
    ),
    "F-06_keep": (
        _rules(
            [KEEP_TRADE],
            ["pre", "post"],
            {
                "pre": Modifier("pre", "PreProcessing", test("position_source_type_id", "==", 7)),
                "post": Modifier("post", "PostProcessing", test("position_source_type_id", "In", [7, 8]), "both", "or"),
            },
        ),
        one_view_sql(f"position_source_type_id <> 7 AND ({TRADE_SQL} OR position_source_type_id IN (7, 8))"),
    ),
    "F-07_scale": (
        _rules(
            [
                rule(test("liquidity_type_id", ">", 5), percent=50),
                rule(test("trade_type_id", "==", 2), "holding", percent=25),
            ]
        ),
        one_view_sql(
            "TRUE",
            "(CASE WHEN liquidity_type_id > 5 THEN 0.5 ELSE 1.0 END) * "
            "(CASE WHEN container = 'holding' AND trade_type_id = 2 THEN 0.25 ELSE 1.0 END)",
        ),
    ),
    "F-09_group_saviour_in": (_rules([KEEP_TRADE], ["pre", "m"], GROUP_MODIFIERS), _group_sql(False)),
    "F-09_group_saviour_not_in": (_rules([KEEP_TRADE], ["pre", "n"], GROUP_MODIFIERS), _group_sql(True)),
}


def _factors(spark, folder):
    rows = factors(positions(spark, folder), views())
    return rows.select("config", "perspective_id", "container", "identifier", "factor")


QUERIES["F-08_factor"] = (
    _factors,
    with_tables("SELECT 'main' AS config, pid AS perspective_id, container, identifier, factor FROM kp", KEPT),
)


def _many(spark, folder):
    """Fifty views in one pass."""
    rules = {
        str(-n): {
            "rules": [
                rule(test("trade_type_id", "<=", n % 5 + 1)),
                rule(test("liquidity_type_id", ">", n % 9), percent=50),
            ]
        }
        for n in range(1, 51)
    }
    vs = view_set({"many": {pid: [] for pid in rules}}, rules)
    rows = factors(positions(spark, folder), vs, ["initial_weight"])
    return rows.groupBy("config", "perspective_id", "container").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.col("initial_weight") * F.col("factor")).alias("mass")
    )


QUERIES["F-13_many_perspectives"] = (
    _many,
    with_tables(
        """SELECT 'many' AS config, -CAST(n AS BIGINT) AS perspective_id, container, COUNT(*) AS kept,
  SUM(initial_weight * CASE WHEN liquidity_type_id > n % 9 THEN 0.5 ELSE 1.0 END) AS mass
FROM pos JOIN generate_series(1, 50) AS s(n) ON trade_type_id <= n % 5 + 1 GROUP BY n, container"""
    ),
)

def _thousand(spark, folder):
    """A thousand views with criteria of their own, more than one mask word can hold."""
    rules = {
        str(-n): {
            "rules": [
                rule(test("trade_type_id", "<=", n % 5 + 1)),
                {**rule(test("instrument_id", ">", 40 * n)), "condition_for_next_rule": "or"},
                rule(test("sub_portfolio_id", "==", n % 10)),
            ]
        }
        for n in range(1, 1001)
    }
    rows = factors(positions(spark, folder), view_set({"many": {pid: [] for pid in rules}}, rules), ["initial_weight"])
    return rows.groupBy("perspective_id", "container").agg(
        F.count(F.lit(1)).alias("kept"), F.sum(F.col("initial_weight") * F.col("factor")).alias("mass")
    )


QUERIES["F-13_thousand_perspectives"] = (
    _thousand,
    with_tables(
        """SELECT -CAST(n AS BIGINT) AS perspective_id, container, COUNT(*) AS kept, SUM(initial_weight) AS mass
FROM pos JOIN generate_series(1, 1000) AS s(n) ON (trade_type_id <= n % 5 + 1 AND instrument_id > 40 * n) OR sub_portfolio_id = n % 10
GROUP BY n, container"""
    ),
)


def _rule_result(spark, folder):
    """Positions kept because another one of their simulated trade passes."""
    vs = view_set({"main": {"-1": ["m"]}}, {"-1": {"rules": [KEEP_TRADE]}}, modifiers=GROUP_MODIFIERS)
    rows = factors(positions(spark, folder), vs, ["trade_type_id"])
    return rows.where("NOT trade_type_id IN (1, 2)").select("container", "identifier")


QUERIES["P-19_rule_result"] = (
    _rule_result,
    with_tables(
        f"SELECT container, identifier FROM pos WHERE NOT {TRADE_SQL} AND simulated_trade_id IN "
        f"(SELECT simulated_trade_id FROM pos WHERE {TRADE_SQL})"
    ),
)

# --- built-in modifiers ------------------------------------------------------

SUBTYPES = """
parent_ids AS (SELECT DISTINCT parent_instrument_id AS id FROM raw_pos WHERE parent_instrument_id IS NOT NULL),
psub AS (SELECT instrument_id AS id, instrument_subtype_id AS subtype FROM instruments
         WHERE instrument_id IN (SELECT id FROM parent_ids))"""
SUBTYPE_OK = "COALESCE((SELECT subtype FROM psub WHERE id = {t}.parent_instrument_id) NOT IN (93, 94), TRUE)"
MODIFIER_KEEP = {
    "MD-01_exclude_other_net_assets": "liquidity_type_id <> 2",
    "MD-02_exclude_class_positions": "is_class_position IS DISTINCT FROM TRUE",
    "MD-03_exclude_non_class_positions": "is_class_position IS DISTINCT FROM FALSE",
    "MD-04_exclude_future_in_kind_delivery": "trade_type_id <> 1",
    "MD-05_exclude_future_trades": "NOT (trade_type_id = 4 AND upcoming_trade_date IS NOT DISTINCT FROM TRUE)",
    "MD-06_exclude_future_flows": "NOT (liquidity_type_id = 3 AND upcoming_trade_date IS NOT DISTINCT FROM TRUE)",
    "MD-07_exclude_pending_stop_trades": "trade_type_id <> 2",
    "MD-08_exclude_pending_limit_trades": "trade_type_id <> 3",
    "MD-09_exclude_potential_red_flags": "red_flag_exclusion_type_id = -2147483648",
    "MD-10_exclude_simulated_trades": (
        "NOT ((position_source_type_id = 10 AND (liquidity_type_id = -2147483648 OR liquidity_type_id <> 5)) "
        "OR simulated_trade_id <> -2147483648)"
    ),
    "MD-11_exclude_simulated_cash": "NOT (position_source_type_id = 10 AND liquidity_type_id = 5)",
    "MD-12_exclude_pending_trades": "position_source_type_id <> 9",
    "MD-13_exclude_current_flow": "NOT (liquidity_type_id = 3 AND upcoming_trade_date IS NOT DISTINCT FROM FALSE)",
    "MD-14_exclude_manual_corrections": "position_source_type_id <> 8",
    "MD-15_exclude_initial_positions": "position_source_type_id NOT IN (1, 9, 11)",
    "MD-16_exclude_blocked_positions": "position_blocking_type_id = -2147483648",
}
SAVIOUR_KEEP = {
    "MD-18_include_all_trade_cash": f"({TRADE_SQL} OR (position_source_type_id = 10 AND liquidity_type_id = 6))",
    "MD-20_exclude_trade_cash": f"({TRADE_SQL} AND NOT (position_source_type_id = 10 AND liquidity_type_id = 6))",
    "MD-21_exclude_perspective_level_simulated_cash": (
        f"({TRADE_SQL} OR (position_source_type_id = 10 AND liquidity_type_id = 5 AND perspective_id IN (-2147483648, -1)))"
    ),
    "MD-22_include_simulated_cash": f"({TRADE_SQL} OR (position_source_type_id = 10 AND liquidity_type_id = 5))",
}


def _name(key: str) -> str:
    return key.split("_", 1)[1]


def _trade_cash(table: str) -> str:
    return f"""({TRADE_SQL} OR (position_source_type_id = 10 AND liquidity_type_id = 6)
  OR simulated_trade_id IN (SELECT simulated_trade_id FROM {table} WHERE {TRADE_SQL}))"""


QUERIES |= {key: (_rules([], [_name(key)]), one_view_sql(keep)) for key, keep in MODIFIER_KEEP.items()}
QUERIES |= {key: (_rules([KEEP_TRADE], [_name(key)]), one_view_sql(keep)) for key, keep in SAVIOUR_KEEP.items()}
QUERIES["MD-19_include_trade_cash_within_perspective"] = (
    _rules([KEEP_TRADE], ["include_trade_cash_within_perspective"]),
    one_view_sql(_trade_cash("pos"), "1.0", _trade_cash("lt")),
)


def references(spark, folder) -> ReferenceTables:
    table = datasets.instruments(spark, folder)
    return ReferenceTables(
        instrument={"instrument": (table, ["instrument_subtype_id"])},
        parent_instrument=(table, ["instrument_subtype_id"]),
        asset_allocation=(datasets.allocation_categories(spark, folder), ["category_name"]),
    )


def _accrual(spark, folder):
    pos, lt = attach_reference(positions(spark, folder), lookthroughs(spark, folder), references(spark, folder))
    vs = view_set({"main": {"-1": ["exclude_other_net_assets_excl_investment_grade_accrual"]}})
    return kept_summary(both(run_views(pos, lt, vs)))


QUERIES["MD-17_exclude_other_net_assets_excl_investment_grade_accrual"] = (
    _accrual,
    one_view_sql(
        f"NOT (liquidity_type_id = 2 AND {SUBTYPE_OK.format(t='pos')})",
        "1.0",
        f"NOT (c.liquidity_type_id = 2 AND {SUBTYPE_OK.format(t='c')})",
        INSTRUMENTS,
        SUBTYPES,
    ),
)


def _defaults(spark, folder):
    """Default modifiers, an override and two configs."""
    configs = {
        "with_default": {"-1": None, "-2": ["exclude_simulated_cash"]},
        "overridden": {"-1": ["include_all_trade_cash"]},
    }
    vs = view_set(configs, {"-1": {"rules": [KEEP_TRADE]}, "-2": {"rules": [KEEP_TRADE]}}, defaults=DEFAULT_MODIFIERS)
    rows = factors(positions(spark, folder), vs)
    return rows.groupBy("config", "perspective_id", "container").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("instrument_id").alias("instruments")
    )


def _default_part(config: str, pid: int, keep: str) -> str:
    return f"""SELECT '{config}' AS config, CAST({pid} AS BIGINT) AS perspective_id, container, COUNT(*) AS kept,
  CAST(SUM(instrument_id) AS BIGINT) AS instruments FROM pos WHERE {keep} GROUP BY container"""


QUERIES["MD-21_default_and_overrides"] = (
    _defaults,
    with_tables(
        " UNION ALL ".join(
            [
                _default_part(
                    "with_default", -1, SAVIOUR_KEEP["MD-21_exclude_perspective_level_simulated_cash"]
                ),
                _default_part(
                    "with_default",
                    -2,
                    f"{TRADE_SQL} AND NOT (position_source_type_id = 10 AND liquidity_type_id = 5)",
                ),
                _default_part("overridden", -1, SAVIOUR_KEEP["MD-18_include_all_trade_cash"]),
            ]
        )
    ),
)

# --- lookthroughs and rescaling ---------------------------------------------


def _sync(keep_removed):
    def run(spark, folder):
        vs = views()
        carry = ["initial_weight"]
        pos_eval = evaluate(positions(spark, folder), vs, carry)
        lt_eval = evaluate(lookthroughs(spark, folder), vs, carry)
        from foliolens.operators.factors import explode_views

        rows = sync_lookthroughs(lt_eval, pos_eval, vs, keep_removed)
        columns = ["container", "record_type", "sub_portfolio_id", "instrument_id", "initial_weight"]
        return kept_summary(explode_views(rows, vs, columns))

    return run


def _sync_rows(spark, folder):
    vs = views()
    lt = factors(lookthroughs(spark, folder), vs, ["initial_weight"])
    return kept_summary(sync_factor_rows(lt, factors(positions(spark, folder), vs)))


SYNC_SQL = with_tables(kept_sql("SELECT * FROM kl"), KEPT)
QUERIES["L-01_sync_lookthroughs"] = (_sync(False), SYNC_SQL)
QUERIES["L-01_sync_hot_parents_salted"] = (_sync(True), SYNC_SQL)
QUERIES["L-01_sync_factor_rows"] = (_sync_rows, SYNC_SQL)


def _expand(spark, folder):
    result = main(spark, folder)
    rows = expand_lookthroughs(
        result.positions, result.lookthroughs, ESSENTIAL, {"instrument_id": "child_id", "weight": "child_weight"}
    )
    return rows.groupBy("perspective_id", "container", "identifier").agg(
        F.count("child_id").alias("children"), F.sum("child_id").alias("child_ids"), F.sum("child_weight").alias("child_weight")
    )


QUERIES["L-02_expand_lookthroughs"] = (
    _expand,
    with_tables(
        """SELECT p.pid AS perspective_id, p.container, p.identifier, COUNT(c.instrument_id) AS children,
  CAST(SUM(c.instrument_id) AS BIGINT) AS child_ids, SUM(c.weight) AS child_weight
FROM kp p LEFT JOIN (SELECT * FROM kl WHERE record_type = 'essential_lookthroughs') c
  ON c.pid = p.pid AND c.container = p.container AND c.parent_instrument_id = p.instrument_id
  AND c.sub_portfolio_id = p.sub_portfolio_id
GROUP BY p.pid, p.container, p.identifier""",
        KEPT,
    ),
)


def _weights(*modifiers: str):
    def run(spark, folder):
        rows = main(spark, folder, *modifiers).positions
        return rows.select(
            "config", "perspective_id", "container", "identifier", *[F.round(out(w), 9).alias(w) for w in SUM_LABELS]
        )

    return run


def _rescaled_sql(rescaled: bool) -> str:
    if not rescaled:
        outs = ", ".join(f"ROUND({w} * factor, 9) AS {w}" for w in SUM_LABELS)
        return with_tables(f"SELECT 'main' AS config, pid AS perspective_id, container, identifier, {outs} FROM kp", KEPT)
    outs = ", ".join(
        f"ROUND(kp.{w} * CASE WHEN m.{SHORT[w]} <> 0 THEN factor / m.{SHORT[w]} ELSE factor END, 9) AS {w}"
        for w in SUM_LABELS
    )
    return with_tables(
        f"SELECT 'main' AS config, kp.pid AS perspective_id, kp.container, identifier, {outs} "
        "FROM kp JOIN mass m ON m.pid = kp.pid AND m.container = kp.container",
        KEPT,
        MASSES,
    )


QUERIES["N-06_build_weight_columns"] = (_weights(), _rescaled_sql(False))
QUERIES["MD-23_scale_holdings_to_100_percent"] = (_weights(HOLD), _rescaled_sql(True))


def _rescale_many_requests(spark, folder):
    """Requests of unknown number: one per sub-portfolio, joined with salts."""
    pos = positions(spark, folder).withColumn("request_id", F.concat(F.lit("r"), F.col("sub_portfolio_id")))
    lt = lookthroughs(spark, folder).withColumn("request_id", F.concat(F.lit("r"), F.col("sub_portfolio_id")))
    rows = run_views(pos, lt, views(HOLD)).positions
    return rows.groupBy("request_id", "perspective_id", "container").agg(
        F.count(F.lit(1)).alias("kept"), F.round(F.sum(out("initial_weight")), 6).alias("share")
    )


QUERIES["A-01_rescale_holdings"] = (
    _rescale_many_requests,
    with_tables(
        """SELECT 'r' || kp.sub_portfolio_id AS request_id, kp.pid AS perspective_id, kp.container, COUNT(*) AS kept,
  ROUND(SUM(kp.initial_weight * (kp.factor / m.iw)), 6) AS share
FROM kp JOIN (SELECT pid, container, sub_portfolio_id, SUM(initial_weight * factor) AS iw FROM (
    SELECT pid, container, sub_portfolio_id, initial_weight, factor FROM kp UNION ALL
    SELECT pid, container, sub_portfolio_id, initial_weight, factor FROM kl WHERE record_type = 'essential_lookthroughs')
  GROUP BY ALL) m ON m.pid = kp.pid AND m.container = kp.container AND m.sub_portfolio_id = kp.sub_portfolio_id
GROUP BY ALL""",
        KEPT,
    ),
)


def _totals(spark, folder):
    return raw_totals(positions(spark, folder), lookthroughs(spark, folder), ALL_LABELS).drop("request_id")


QUERIES["A-02_raw_totals"] = (
    _totals,
    with_tables(
        "SELECT container, " + ", ".join(f"{s} AS {w}" for w, s in SHORT.items()) + " FROM tot", TOTALS
    ),
)


def _masses(spark, folder):
    vs = views(HOLD)
    pos_eval = evaluate(positions(spark, folder), vs)
    lt_eval = evaluate(lookthroughs(spark, folder).where(F.col("record_type") == ESSENTIAL), vs)
    rows = group_masses(pos_eval, sync_lookthroughs(lt_eval, pos_eval, vs, keep_removed=True), vs, ALL_LABELS)
    return rows.where("view >= 0").selectExpr("-1 - view AS perspective_id", "container", *ALL_LABELS)


QUERIES["A-01_group_masses"] = (
    _masses,
    # views are numbered in the order of their ids: -3 is 0, -2 is 1, -1 is 2
    with_tables(
        "SELECT CAST(-4 - pid AS INTEGER) AS perspective_id, container, "
        + ", ".join(f"{s} AS {w}" for w, s in SHORT.items())
        + " FROM mass",
        KEPT,
        MASSES,
    ),
)

SF_COLUMNS = ["config", "perspective_id", "container", "weight_label"]


def _scale_factors(spark, folder):
    rows = main(spark, folder, HOLD).scale_factors
    return rows.select(*SF_COLUMNS, F.round("scale_factor", 9).alias("scale_factor"))


def _scale_factors_again(spark, folder):
    result = main(spark, folder, HOLD)
    rows = scale_factors_from_result(
        result.raw_positions, result.raw_lookthroughs, result.positions, result.lookthroughs, result.views, ALL_LABELS
    )
    return rows.select(*SF_COLUMNS, F.round("scale_factor", 9).alias("scale_factor"))


def _sf_sql() -> str:
    parts = []
    for containers, labels in (
        ("('holding')", datasets.POSITION_LABELS),
        ("('selected_reference', 'contractual_reference')", ["weight"]),
    ):
        for w in labels:
            s = SHORT[w]
            parts.append(
                f"""SELECT 'main' AS config, v.pid AS perspective_id, t.container, '{w}' AS weight_label,
  ROUND(CASE WHEN t.{s} = 0 THEN NULL WHEN COALESCE(m.{s}, 0) = 0 THEN 1.0 ELSE m.{s} / t.{s} END, 9) AS scale_factor
FROM tot t CROSS JOIN (SELECT UNNEST([-1, -2, -3]) AS pid) v LEFT JOIN mass m ON m.container = t.container AND m.pid = v.pid
WHERE t.container IN {containers}"""
            )
    return with_tables(" UNION ALL ".join(parts), KEPT, MASSES, TOTALS)


QUERIES["A-03_scale_factors"] = (_scale_factors, _sf_sql())
QUERIES["A-08_scale_factors_from_result"] = (_scale_factors_again, _sf_sql())


def _default_factors(spark, folder):
    vs = view_set({"main": {"-1": [HOLD], "-2": [], "-3": []}}, CRITERIA_RULES)
    result = run_views(positions(spark, folder), lookthroughs(spark, folder), vs)
    rows = result.all_scale_factors
    return rows.select(*SF_COLUMNS, F.round("scale_factor", 9).alias("scale_factor"))


QUERIES["A-11_default_scale_factors"] = (
    _default_factors,
    "SELECT config, perspective_id, container, weight_label, "
    "CASE WHEN perspective_id = -1 THEN scale_factor ELSE 1.0 END AS scale_factor FROM (" + _sf_sql() + ")",
)


def _with_subtypes(spark, folder):
    """Positions and children with the subtype of their own instrument."""
    return attach_reference(positions(spark, folder), lookthroughs(spark, folder), references(spark, folder))


def _rescale_lookthroughs(spark, folder):
    pos, lt = _with_subtypes(spark, folder)
    rows = run_views(pos, lt, views(LOOK)).lookthroughs
    return rows.groupBy("config", "perspective_id", "container", "record_type", "sub_portfolio_id").agg(
        F.count(F.lit(1)).alias("kept"), F.round(F.sum(out("weight")), 9).alias("weight")
    )


def _rescaled_parents(spark, folder):
    """The built-in flag, for parents of the subtypes it names and for others; per parent."""
    pos, lt = _with_subtypes(spark, folder)
    rows = run_views(pos, lt, views(LOOK)).lookthroughs
    return rows.groupBy("perspective_id", "container", "record_type", "parent_instrument_id", "sub_portfolio_id").agg(
        F.count(F.lit(1)).alias("kept"), F.round(F.sum(out("weight")), 9).alias("weight")
    )


MATCHES = """
match AS (SELECT instrument_id AS id, bool_or(instrument_subtype_id IN (27, 38, 66, 81, 84)) AS m
          FROM raw_pos LEFT JOIN instruments USING (instrument_id) GROUP BY 1)"""
QUERIES["A-04_rescale_lookthroughs"] = (
    _rescale_lookthroughs,
    with_tables(
        """SELECT 'main' AS config, pid AS perspective_id, container, record_type, sub_portfolio_id, COUNT(*) AS kept,
  ROUND(SUM(weight * CASE WHEN m AND den <> 0 THEN factor / den ELSE factor END), 9) AS weight
FROM (SELECT kl.*, COALESCE(m, FALSE) AS m,
        SUM(weight * factor) OVER (PARTITION BY pid, container, parent_instrument_id, record_type, sub_portfolio_id) AS den
      FROM kl LEFT JOIN match ON match.id = kl.parent_instrument_id)
GROUP BY pid, container, record_type, sub_portfolio_id""",
        INSTRUMENTS,
        KEPT,
        MATCHES,
    ),
)
def _rescale_sixty(spark, folder):
    """Sixty rescaling views, with scaling rules of their own."""
    pos, lt = _with_subtypes(spark, folder)
    rules = {
        str(-n): {"rules": [rule(test("trade_type_id", "<=", n % 5 + 1)), rule(test("liquidity_type_id", ">", n % 9), percent=50)]}
        for n in range(1, 61)
    }
    rows = run_views(pos, lt, view_set({"many": {pid: [LOOK] for pid in rules}}, rules)).lookthroughs
    total = F.round(F.sum(out("weight")), 9)  # else the order of summation decides how a tie of the next rounding falls
    return rows.groupBy("perspective_id", "container", "record_type").agg(
        F.count(F.lit(1)).alias("kept"), F.round(total, 6).alias("weight")
    )


QUERIES["A-04_sixty_views"] = (
    _rescale_sixty,
    with_tables(
        """, view AS (SELECT n FROM generate_series(1, 60) AS s(n)),
parent AS (SELECT DISTINCT n, container, instrument_id, sub_portfolio_id FROM pos JOIN view ON trade_type_id <= n % 5 + 1),
child AS (
  SELECT n, lt.*, CASE WHEN liquidity_type_id > n % 9 THEN 0.5 ELSE 1.0 END AS factor
  FROM lt JOIN view ON trade_type_id <= n % 5 + 1
  SEMI JOIN parent ON parent.n = view.n AND parent.container = lt.container
    AND parent.instrument_id = lt.parent_instrument_id AND parent.sub_portfolio_id = lt.sub_portfolio_id),
divided AS (
  SELECT child.*, COALESCE(m, FALSE) AS m,
    SUM(weight * factor) OVER (PARTITION BY n, container, parent_instrument_id, record_type, sub_portfolio_id) AS den
  FROM child LEFT JOIN match ON match.id = child.parent_instrument_id)
SELECT -CAST(n AS BIGINT) AS perspective_id, container, record_type, COUNT(*) AS kept,
  ROUND(SUM(weight * CASE WHEN m AND den <> 0 THEN factor / den ELSE factor END), 6) AS weight
FROM divided GROUP BY n, container, record_type""",
        INSTRUMENTS,
        MATCHES,
    ),
)
QUERIES["MD-24_scale_lookthroughs_to_100_percent"] = (
    _rescaled_parents,
    with_tables(
        """SELECT pid AS perspective_id, container, record_type, parent_instrument_id, sub_portfolio_id, COUNT(*) AS kept,
  ROUND(CASE WHEN m AND SUM(weight * factor) <> 0 THEN 1.0 ELSE SUM(weight * factor) END, 9) AS weight
FROM (SELECT kl.*, COALESCE(m, FALSE) AS m FROM kl LEFT JOIN match ON match.id = kl.parent_instrument_id)
GROUP BY pid, container, record_type, parent_instrument_id, sub_portfolio_id, m""",
        INSTRUMENTS,
        KEPT,
        MATCHES,
    ),
)


def _matching(spark, folder):
    pos, _ = _with_subtypes(spark, folder)
    rows = matching_parents(pos, view_set({"main": {"-1": [LOOK]}}))
    return rows.select(F.col("parent_instrument_id").alias("instrument_id"))


QUERIES["A-05_matching_parents"] = (
    _matching,
    with_tables("SELECT id AS instrument_id FROM match WHERE m", INSTRUMENTS, MATCHES),
)


def _distinct_parents(spark, folder):
    vs = views()
    masks = parent_masks(evaluate(positions(spark, folder), vs), vs)
    return masks.groupBy("container", "sub_portfolio_id").agg(
        F.count(F.lit(1)).alias("parents"), F.sum("parent_instrument_id").alias("ids")
    )


QUERIES["A-07_distinct_parents"] = (
    _distinct_parents,
    with_tables(
        """SELECT container, sub_portfolio_id, COUNT(*) AS parents, CAST(SUM(instrument_id) AS BIGINT) AS ids
FROM (SELECT DISTINCT container, instrument_id, sub_portfolio_id FROM kp) GROUP BY ALL""",
        KEPT,
    ),
)


def _window(spark, folder):
    """Flag "some row of my simulated trade passes", as one aggregate per group."""
    rows = positions(spark, folder)
    passing = (
        rows.groupBy("request_id", "simulated_trade_id")
        .agg(F.bool_or(F.col("trade_type_id").isin(1, 2) & (F.col("weight") > 10)).alias("passes"))
    )
    flagged = join_groups(rows, passing, ["request_id", "simulated_trade_id"])
    return flagged.select("identifier", "simulated_trade_id", F.coalesce("passes", F.lit(False)).alias("passes"))


QUERIES["W-01_group_flag"] = (
    _window,
    with_tables(
        "SELECT identifier, simulated_trade_id, COALESCE(bool_or(trade_type_id IN (1, 2) AND weight > 10) "
        "OVER (PARTITION BY simulated_trade_id), FALSE) AS passes FROM pos"
    ),
)


def _view_group_flags(spark, folder):
    """The flags that views with a group modifier get: does a row of my simulated trade pass the rules?"""
    siblings = Modifier("siblings", "PostProcessing", GROUP_IN, "both", "or")
    vs = view_set({"main": {pid: ["siblings"] for pid in CRITERIA_RULES}}, CRITERIA_RULES, modifiers={"siblings": siblings})
    flagged = with_group_flags(positions(spark, folder), vs)
    flags = [F.expr(f"coalesce({bit(v, '_g0_simulated_trade_id_')}, false)").alias(f"passes{-v.perspective_id}") for v in vs.views]
    return flagged.select("container", "identifier", "simulated_trade_id", *flags)


QUERIES["W-01_flags_of_views"] = (
    _view_group_flags,
    with_tables(
        "SELECT container, identifier, simulated_trade_id, "
        + ", ".join(f"bool_or({keep}) OVER (PARTITION BY simulated_trade_id) AS passes{-pid}" for pid, keep, _ in VIEWS_SQL)
        + " FROM pos"
    ),
)


def _container_totals(spark, folder):
    """All positions beside the kept mass of their container in each view."""
    result = main(spark, folder, HOLD)
    rows, totals = with_container_totals(result.evaluated_positions, result.views, result.position_labels, result.masses)
    label = result.position_labels.index("initial_weight")
    places = [F.expr(totals.place(v.index, label)).alias(f"total{-v.perspective_id}") for v in result.views.views]
    return rows.select("container", "identifier", *places)


QUERIES["J-05_container_totals"] = (
    _container_totals,
    with_tables(
        "SELECT container, identifier, "
        + ", ".join(f"(SELECT iw FROM mass m WHERE m.pid = {pid} AND m.container = pos.container) AS total{-pid}" for pid, _, _ in VIEWS_SQL)
        + " FROM pos",
        KEPT,
        MASSES,
    ),
)


def flagship(spark, folder) -> DataFrame:
    """Filter rule, scaling rule and rescale to 100 percent over positions and children."""
    vs = view_set({"main": {"-1": [HOLD]}}, {"-1": CRITERIA_RULES["-1"]})
    rows = run_views(positions(spark, folder), lookthroughs(spark, folder), vs).positions
    return rows.select(
        "config",
        "perspective_id",
        "container",
        "identifier",
        "factor",
        F.round(out("initial_weight"), 9).alias("initial_weight"),
    )


QUERIES["flagship_rescaled_view"] = (
    flagship,
    with_tables(
        """SELECT 'main' AS config, CAST(kp.pid AS BIGINT) AS perspective_id, kp.container, identifier, factor,
  ROUND(initial_weight * (factor / m.iw), 9) AS initial_weight
FROM kp JOIN mass m ON m.pid = kp.pid AND m.container = kp.container WHERE kp.pid = -1""",
        KEPT,
        MASSES,
    ),
)
