"""Exposure, benchmark and active-weight metrics over the whole tables."""

from __future__ import annotations



from pyspark.sql import DataFrame, functions as F

from foliolens.operators.metrics import (
    METRICS,
    active_weights,
    all_levels,
    exposure_metrics,
    fill_null_nan,
    group_exposures,
    grouped_exposures,
    normalize_columns,

    scale_row,
    small_to_zero,
    value_columns,
)
from foliolens.plans.pipeline import run_views
from foliolens.plans.reuse import materialize_if_possible
from foliolens.registry.inputs import lookthroughs, positions, with_tables
from foliolens.registry.view_queries import HOLD, KEPT, MASSES, TOTALS, views
from foliolens.schema import VIEW_KEYS

CARRY = ["initial_shares", "resulting_shares", "trade_type_id"]


def result(spark, folder, *modifiers: str):
    return run_views(
        positions(spark, folder), lookthroughs(spark, folder), views(*modifiers), carry=CARRY
    )


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All fractions rounded; 0 has no sign."""
    return df.select(
        *[
            (F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
            if c != "request_id"
        ]
    )


def _summary(rows: DataFrame, *more: str) -> DataFrame:
    keys = [*VIEW_KEYS, "container", "sub_portfolio_id"]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("instrument_id").alias("instruments"),
        F.sum("parent_instrument_id").alias("parents"),
        *[F.sum(m).alias(m) for m in [*METRICS, *more]],
    )


JOINED = {
    "no": "SELECT kp.*, NULL::BIGINT AS child, NULL::DOUBLE AS child_weight FROM kp",
    **{
        level: f"""SELECT kp.*, c.instrument_id AS child, c.weight AS child_weight FROM kp LEFT JOIN
    (SELECT * FROM kl WHERE record_type = '{level}_lookthroughs') c ON c.pid = kp.pid AND c.container = kp.container
    AND c.parent_instrument_id = kp.instrument_id AND c.sub_portfolio_id = kp.sub_portfolio_id"""
        for level in ("essential", "complete")
    },
}


def rows_sql(level: str) -> str:
    """Row-level metrics of a level as a CTE named after it."""
    infix = "" if level == "no" else "exposure_"
    child = "COALESCE(child_weight, 1.0)"
    return f"""m_{level} AS (SELECT 'main' AS config, pid AS perspective_id, container, sub_portfolio_id, trade_type_id,
  COALESCE(child, instrument_id) AS instrument_id, instrument_id AS parent_instrument_id,
  initial_shares, NULLIF(resulting_shares, -2147483648) AS resulting_shares,
  CASE WHEN container = 'holding' THEN initial_{infix}weight * factor * {child} END AS PI,
  CASE WHEN container = 'holding' THEN resulting_{infix}weight * factor * {child} END AS PR,
  CASE WHEN container = 'selected_reference' THEN weight * factor END AS BS,
  CASE WHEN container = 'contractual_reference' THEN weight * factor END AS BC
  FROM ({JOINED[level]}))"""


GROUPED = "config, perspective_id, instrument_id, parent_instrument_id, sub_portfolio_id"


def grouped_sql(level: str, extra: str = "", shares: bool = True) -> str:
    share_columns = (
        ", CAST(COALESCE(SUM(initial_shares), 0) AS BIGINT) AS initial_shares, "
        "CAST(COALESCE(SUM(resulting_shares), 0) AS BIGINT) AS resulting_shares"
        if shares
        else ""
    )
    sums = ", ".join(f"COALESCE(SUM({m}), 0) AS {m}" for m in METRICS)
    return f"g_{level} AS (SELECT {GROUPED}{extra}, {sums}{share_columns} FROM m_{level} GROUP BY {GROUPED}{extra})"


def _level(level: str):
    def run(spark, folder):
        r = result(spark, folder)
        return _summary(exposure_metrics(r.positions, r.lookthroughs, level))

    return run


SUMS = ", ".join(f"SUM({m}) AS {m}" for m in METRICS)
QUERIES = {
    f"M-01_exposure_metrics_{level}": (
        _level(level),
        with_tables(
            f"""SELECT config, perspective_id, container, sub_portfolio_id, COUNT(*) AS rows,
  CAST(SUM(instrument_id) AS BIGINT) AS instruments, CAST(SUM(parent_instrument_id) AS BIGINT) AS parents, {SUMS}
FROM m_{level} GROUP BY ALL""",
            KEPT,
            rows_sql(level),
        ),
    )
    for level in ("no", "essential", "complete")
}


def _group(fused: bool, attributes: list[str] | None = None):
    def run(spark, folder):
        r = result(spark, folder)
        if fused:
            rows = grouped_exposures(r.positions, r.lookthroughs, "essential", attributes)
        else:
            rows = group_exposures(exposure_metrics(r.positions, r.lookthroughs, "essential", attributes), attributes)
        return rows.drop("request_id")

    return run


GROUP_SQL = with_tables("SELECT * FROM g_essential", KEPT, rows_sql("essential"), grouped_sql("essential"))
QUERIES["A-09_group_exposures"] = (_group(False), GROUP_SQL)
QUERIES["A-09_group_exposures_presummed"] = (_group(True), GROUP_SQL)
QUERIES["A-09_group_exposures_by_attribute"] = (
    _group(True, ["trade_type_id"]),
    with_tables(
        "SELECT * FROM g_essential", KEPT, rows_sql("essential"), grouped_sql("essential", ", trade_type_id")
    ),
)


def _rekey(spark, folder):
    r = result(spark, folder)
    rows = exposure_metrics(r.positions, r.lookthroughs, "complete")
    return rows.groupBy("perspective_id", "instrument_id", "parent_instrument_id").agg(F.count(F.lit(1)).alias("rows"))


QUERIES["M-03_re_key"] = (
    _rekey,
    with_tables(
        "SELECT perspective_id, instrument_id, parent_instrument_id, COUNT(*) AS rows FROM m_complete GROUP BY ALL",
        KEPT,
        rows_sql("complete"),
    ),
)
VALUES = ", ".join(f"{m} * 1000000 AS {m}V" for m in METRICS)
NAMES = {
    "PI": "total_net_assets_initial_portfolio",
    "PR": "total_net_assets_resulting_portfolio",
    "BS": "total_net_assets_selected_benchmark",
    "BC": "total_net_assets_contractual_benchmark",
}
METRIC_COLUMNS = [*METRICS, *[f"{m}V" for m in METRICS]]


def _values(spark, folder):
    r = result(spark, folder)
    rows = value_columns(grouped_exposures(r.positions, r.lookthroughs, "essential"))
    return rows.select(*VIEW_KEYS, "instrument_id", "parent_instrument_id", "sub_portfolio_id", *METRIC_COLUMNS)


BASE = (KEPT, rows_sql("essential"), grouped_sql("essential", shares=False))
QUERIES["M-04_value_columns"] = (
    _values,
    with_tables(f"SELECT {GROUPED}, {', '.join(METRICS)}, {VALUES} FROM g_essential", *BASE),
)


def _asset_totals(spark, folder):
    """Total net assets from the tables: one row of totals for the request."""
    from foliolens import datasets

    customers = datasets.table(spark, folder, "customer").agg(F.floor(F.sum("c_custkey") / 7).cast("double").alias("t"))
    return customers.selectExpr(*[f"t * {i} AS {name}" for i, name in enumerate(NAMES.values(), 1)])


def _values_scaled(spark, folder):
    r = result(spark, folder, HOLD)
    rows = value_columns(
        grouped_exposures(r.positions, r.lookthroughs, "no"), _asset_totals(spark, folder), r.all_scale_factors
    )
    return rows.groupBy(*VIEW_KEYS).agg(*[F.round(F.sum(f"{m}V"), 3).alias(f"{m}V") for m in METRICS])


QUERIES["J-06_cross_join_totals"] = (
    _values_scaled,
    with_tables(
        """SELECT 'main' AS config, pid AS perspective_id,
  ROUND(SUM(CASE WHEN container = 'holding' THEN kp.initial_weight * (factor / m.iw) * t * (m.iw / tot.iw) END), 3) AS PIV,
  ROUND(SUM(CASE WHEN container = 'holding' THEN kp.resulting_weight * (factor / m.rw) * 2 * t * (m.rw / tot.rw) END), 3) AS PRV,
  ROUND(SUM(CASE WHEN container = 'selected_reference' THEN kp.weight * (factor / m.w) * 3 * t * (m.w / tot.w) END), 3) AS BSV,
  ROUND(SUM(CASE WHEN container = 'contractual_reference' THEN kp.weight * (factor / m.w) * 4 * t * (m.w / tot.w) END), 3) AS BCV
FROM kp JOIN mass m USING (pid, container) JOIN tot USING (container)
CROSS JOIN (SELECT SUM(c_custkey) // 7 AS t FROM customer) GROUP BY pid""",
        KEPT,
        MASSES,
        TOTALS,
    ),
)


def _scale_row(spark, folder):
    r = result(spark, folder, HOLD)
    return _rounded(scale_row(r.all_scale_factors), 9)


QUERIES["M-04_scale_row"] = (
    _scale_row,
    with_tables(
        """SELECT 'main' AS config, pid AS perspective_id,
  ROUND(MAX(CASE WHEN container = 'holding' THEN m.iw / tot.iw END), 9) AS _scale_PI,
  ROUND(MAX(CASE WHEN container = 'holding' THEN m.rw / tot.rw END), 9) AS _scale_PR,
  ROUND(MAX(CASE WHEN container = 'selected_reference' THEN m.w / tot.w END), 9) AS _scale_BS,
  ROUND(MAX(CASE WHEN container = 'contractual_reference' THEN m.w / tot.w END), 9) AS _scale_BC
FROM mass m JOIN tot USING (container) GROUP BY pid""",
        KEPT,
        MASSES,
        TOTALS,
    ),
)


def _normalized(spark, folder):
    r = result(spark, folder)
    sums = materialize_if_possible(grouped_exposures(r.positions, r.lookthroughs, "essential"))
    rows = normalize_columns(value_columns(sums))
    return _rounded(
        rows.select(*VIEW_KEYS, "instrument_id", "parent_instrument_id", "sub_portfolio_id", *METRIC_COLUMNS)
    )


QUERIES["A-10_normalize_columns"] = (
    _normalized,
    with_tables(
        f"SELECT {GROUPED}, "
        + ", ".join(f"ROUND({m} * (1.0 / CASE WHEN t{m} <> 0 THEN t{m} ELSE 1.0 END), 6) AS {m}" for m in METRICS)
        + ", "
        + ", ".join(
            f"ROUND({m} * 1000000 * (1.0 / CASE WHEN t{m} <> 0 THEN t{m} ELSE 1.0 END), 6) AS {m}V" for m in METRICS
        )
        + " FROM g_essential JOIN (SELECT perspective_id, "
        + ", ".join(f"SUM({m}) AS t{m}" for m in METRICS)
        + " FROM g_essential GROUP BY 1) USING (perspective_id)",
        *BASE,
    ),
)


def _small(spark, folder):
    rows = positions(spark, folder).selectExpr(
        "identifier",
        "CASE WHEN instrument_id % 3 = 0 THEN 1e-16D ELSE initial_weight END AS PI",
        "CASE WHEN instrument_id % 3 = 1 THEN -1e-15D ELSE resulting_weight END AS PR",
        "weight AS BS",
        "CASE WHEN instrument_id % 3 = 2 THEN 2e-15D ELSE weight END AS BC",
    )
    return small_to_zero(rows)


QUERIES["M-05_small_to_zero"] = (
    _small,
    with_tables(
        """SELECT identifier, CASE WHEN instrument_id % 3 = 0 THEN 0.0 ELSE initial_weight END AS PI,
  CASE WHEN instrument_id % 3 = 1 THEN 0.0 ELSE resulting_weight END AS PR, weight AS BS,
  CASE WHEN instrument_id % 3 = 2 THEN 2e-15 ELSE weight END AS BC FROM pos"""
    ),
)


def _fill(spark, folder):
    rows = positions(spark, folder).selectExpr(
        "identifier",
        "CASE WHEN instrument_id % 3 = 0 THEN double('NaN') ELSE initial_weight END AS PI",
        "resulting_weight AS PR",
        "weight AS BS",
        "CASE WHEN instrument_id % 5 = 0 THEN double('NaN') ELSE weight END AS BCV",
    )
    return fill_null_nan(rows)


QUERIES["M-06_fill_null_nan"] = (
    _fill,
    with_tables(
        """SELECT identifier, CASE WHEN instrument_id % 3 = 0 THEN 0.0 ELSE initial_weight END AS PI,
  resulting_weight AS PR, COALESCE(weight, 0) AS BS,
  CASE WHEN instrument_id % 5 = 0 THEN 0.0 ELSE COALESCE(weight, 0) END AS BCV FROM pos"""
    ),
)
ACTIVE = ["AIC", "ARC", "AIS", "ARS"]


def _active(spark, folder):
    r = result(spark, folder)
    rows = active_weights(value_columns(grouped_exposures(r.positions, r.lookthroughs, "essential")))
    return rows.select(
        *VIEW_KEYS, "instrument_id", "parent_instrument_id", "sub_portfolio_id", *ACTIVE, *[f"{a}V" for a in ACTIVE]
    )


ACTIVE_SQL = {"AIC": "PI - BC", "ARC": "PR - BC", "AIS": "PI - BS", "ARS": "PR - BS"}
QUERIES["M-07_active_weights"] = (
    _active,
    with_tables(
        f"SELECT {GROUPED}, "
        + ", ".join(f"{sql} AS {a}, 1000000 * ({sql}) AS {a}V" for a, sql in ACTIVE_SQL.items())
        + " FROM g_essential",
        *BASE,
    ),
)


def _all_levels(spark, folder):
    """All metrics of all levels and views, with rescaled holdings."""
    r = result(spark, folder)
    rows = all_levels(r.positions, r.lookthroughs, scale_holdings=True, factors=r.all_scale_factors)
    columns = [*METRIC_COLUMNS, *ACTIVE, *[f"{a}V" for a in ACTIVE]]
    return _rounded(
        rows.select("level", *VIEW_KEYS, "instrument_id", "parent_instrument_id", "sub_portfolio_id", *columns)
    )


def _all_levels_sql() -> str:
    ctes = [KEPT]
    parts = []
    for level in ("no", "essential", "complete"):
        ctes += [rows_sql(level), grouped_sql(level, shares=False)]
        parts.append(f"SELECT '{level}' AS level, * FROM g_{level}")
    totals = ", ".join(f"SUM({m}) AS t{m}" for m in METRICS)
    share = {m: f"(1.0 / CASE WHEN t{m} <> 0 THEN t{m} ELSE 1.0 END)" for m in METRICS}
    small = {m: f"CASE WHEN ABS({m} * {share[m]}) <= 1e-15 THEN 0.0 ELSE {m} * {share[m]} END" for m in METRICS}
    norm = (
        f"n AS (SELECT level, {GROUPED}, "
        + ", ".join(f"{small[m]} AS {m}, {m} * 1000000 * {share[m]} AS {m}V" for m in METRICS)
        + f" FROM u JOIN (SELECT level, perspective_id, {totals} FROM u GROUP BY ALL) USING (level, perspective_id))"
    )
    ctes += [f"u AS ({' UNION ALL '.join(parts)})", norm]
    outputs = [f"ROUND({c}, 6) + 0.0 AS {c}" for c in METRIC_COLUMNS]
    outputs += [f"ROUND({sql}, 6) + 0.0 AS {a}, ROUND(1000000 * ({sql}), 6) + 0.0 AS {a}V" for a, sql in ACTIVE_SQL.items()]
    return with_tables(f"SELECT level, {GROUPED}, {', '.join(outputs)} FROM n", *ctes)


QUERIES["M-02_all_levels"] = (_all_levels, _all_levels_sql())


def _denominators(spark, folder):
    """Rows with the total of their group joined back."""
    r = result(spark, folder)
    totals = r.positions.groupBy("config", "perspective_id", "container").agg(F.sum("initial_weight").alias("total"))
    joined = r.positions.join(totals, ["config", "perspective_id", "container"])
    return joined.select("perspective_id", "container", "identifier", "total")


QUERIES["J-05_join_group_denominators"] = (
    _denominators,
    with_tables(
        "SELECT pid AS perspective_id, container, identifier, SUM(initial_weight) OVER (PARTITION BY pid, container) AS total FROM kp",
        KEPT,
    ),
)
