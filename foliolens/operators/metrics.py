"""Exposure, benchmark and active-weight metrics on finished views."""

from __future__ import annotations

import functools
from contextlib import ExitStack

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.expressions import zero_if_missing, zero_if_tiny
from foliolens.operators.lookthrough import expand_lookthroughs
from foliolens.operators.skew import join_groups
from foliolens.plans.reuse import DEALT, materialize, materialize_if_possible, settings, shared_folder, stored_while
from foliolens.schema import (
    COMPLETE,
    CONTRACTUAL,
    ESSENTIAL,
    HOLDING,
    INT_NULL,
    REQUEST,
    SELECTED,
    VIEW_KEYS,
    out,
    present,
)

METRICS = ["PI", "PR", "BS", "BC"]
WEIGHTS = ["initial_weight", "resulting_weight", "initial_exposure_weight", "resulting_exposure_weight"]
SHARES = ["initial_shares", "resulting_shares", "blocked_shares"]
LEVELS = {"no": None, "essential": ESSENTIAL, "complete": COMPLETE}
ASSETS = {
    "PI": "total_net_assets_initial_portfolio",
    "PR": "total_net_assets_resulting_portfolio",
    "BS": "total_net_assets_selected_benchmark",
    "BC": "total_net_assets_contractual_benchmark",
}
DEFAULT_ASSETS = 1_000_000.0
"""Fixed value: total net assets when none are given."""
SCALES = {
    "PI": (HOLDING, "initial_weight"),
    "PR": (HOLDING, "resulting_weight"),
    "BS": (SELECTED, "weight"),
    "BC": (CONTRACTUAL, "weight"),
}
GROUP = ["instrument_id", "parent_instrument_id", "sub_portfolio_id"]


def _weight(df: DataFrame, label: str) -> Column:
    return F.col(out(label)) if out(label) in df.columns else F.lit(None).cast("double")


def _benchmarks(df: DataFrame) -> dict[str, Column]:
    weight = _weight(df, "weight")
    return {
        "BS": F.when(F.col("container") == SELECTED, weight),
        "BC": F.when(F.col("container") == CONTRACTUAL, weight),
    }


def _exposures(df: DataFrame, level: str) -> dict[str, Column]:
    """Position side of PI and PR at a level: holdings only."""
    infix = "" if level == "no" else "exposure_"
    holding = F.col("container") == HOLDING
    return {
        "PI": F.when(holding, _weight(df, f"initial_{infix}weight")),
        "PR": F.when(holding, _weight(df, f"resulting_{infix}weight")),
    }


def _shares(df: DataFrame) -> dict[str, Column]:
    """Share columns, with the missing-value sentinel as NULL."""
    return {c: F.when(F.col(c) != INT_NULL, F.col(c)) for c in present(df, SHARES)}


def exposure_metrics(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    level: str,
    attributes: list[str] | None = None,
    child_weight: str = "raw",
) -> DataFrame:
    """PI, PR, BS and BC of every kept position, drilled down to its children.

    Level ``no`` uses the portfolio weights; the other levels use exposure
    weights, times the weight of the child where there is one. The instrument
    becomes the child, the parent the original instrument. ``child_weight`` is
    ``raw`` or ``factored``.
    """
    extra = [*(attributes or []), *present(positions, SHARES)]
    base = positions.select(
        REQUEST,
        *VIEW_KEYS,
        "container",
        "instrument_id",
        "sub_portfolio_id",
        *extra,
        *[c.alias(n) for n, c in {**_exposures(positions, level), **_benchmarks(positions)}.items()],
    )
    record_type = LEVELS[level]
    if record_type is None or lookthroughs is None:
        rows = base.withColumns({"_child": F.lit(None).cast("long"), "_child_weight": F.lit(None).cast("double")})
    else:
        column = "weight" if child_weight == "raw" else out("weight")
        rows = expand_lookthroughs(
            base, lookthroughs, record_type, {"instrument_id": "_child", column: "_child_weight"}
        )
    has_child = F.col("_child").isNotNull()
    return rows.select(
        REQUEST,
        *VIEW_KEYS,
        "container",
        F.coalesce("_child", "instrument_id").alias("instrument_id"),
        F.col("instrument_id").alias("parent_instrument_id"),
        "sub_portfolio_id",
        *extra,
        *[F.when(has_child, F.col(m) * F.col("_child_weight")).otherwise(F.col(m)).alias(m) for m in ("PI", "PR")],
        "BS",
        "BC",
    )


def _total(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def group_exposures(rows: DataFrame, attributes: list[str] | None = None) -> DataFrame:
    """Sums of the metrics and shares by instrument, parent and sub-portfolio."""
    return rows.groupBy(REQUEST, *VIEW_KEYS, *(attributes or []), *GROUP).agg(
        *[_total(F.col(m)).alias(m) for m in METRICS],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in _shares(rows).items()],
    )


def _parents(positions: DataFrame, levels: list[str], keys: list[str], attributes: list[str]) -> DataFrame:
    """Positions summed per parent key, by one pass, as a row for each level."""
    kinds = {level: "no" if level == "no" else "drilled" for level in levels}
    exposures = {f"{kind}_{n}": c for level, kind in kinds.items() for n, c in _exposures(positions, level).items()}
    common = {**_benchmarks(positions), **_shares(positions)}
    sums = {**exposures, **common}
    grouped = (
        positions.select("*", F.col("instrument_id").alias("_instrument"), *[c.alias(f"_{n}") for n, c in sums.items()])
        .groupBy(*keys, *attributes)
        .agg(*[F.sum(f"_{n}").alias(n) for n in sums])
    )
    own = [[f"'{level}' AS level", f"{kind}_PI AS PI", f"{kind}_PR AS PR"] for level, kind in kinds.items()]
    structs = ", ".join("struct(" + ", ".join(columns) + ")" for columns in own)
    tagged = own[0] if len(own) == 1 else [f"inline(array({structs}))"]
    return grouped.selectExpr(*keys, *attributes, *common, *tagged)


def grouped_exposures(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    level: str,
    attributes: list[str] | None = None,
    child_weight: str = "raw",
) -> DataFrame:
    """``group_exposures(exposure_metrics(...))`` without the row-level drill-down.

    Both sides are summed per key before they meet: the products of sums equal
    the sum of products, so duplicate positions or children of one parent are
    never paired with each other.
    """
    return grouped_levels(positions, lookthroughs, [level], attributes, child_weight).drop("level")


def grouped_levels(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    levels: list[str],
    attributes: list[str] | None = None,
    child_weight: str = "raw",
) -> DataFrame:
    """The same for several levels in one pass, tagged with the level."""
    attributes = attributes or []
    keys = [REQUEST, *VIEW_KEYS, "container", "_instrument", "sub_portfolio_id"]
    names = [*METRICS, *present(positions, SHARES)]
    drilled = [level for level in levels if LEVELS[level] is not None and lookthroughs is not None]
    parents = _parents(positions, levels, keys, attributes)
    if drilled:
        column = "weight" if child_weight == "raw" else out("weight")
        children = (
            lookthroughs.where(F.col("record_type").isin([LEVELS[level] for level in drilled]))
            .withColumn("_instrument", F.col("parent_instrument_id"))
            .groupBy("record_type", *keys, F.col("instrument_id").alias("_child"))
            .agg(F.sum(column).alias("_child_weight"), F.count(F.lit(1)).alias("_children"))
        )
        # what has no child at its level is a leaf there, and so is every position at a level without children
        if len(levels) == 1:
            children, by = children.drop("record_type"), keys
        else:
            level_of = F.expr("CASE record_type " + " ".join(f"WHEN '{LEVELS[v]}' THEN '{v}'" for v in drilled) + " END")
            children, by = children.withColumn("level", level_of).drop("record_type"), ["level", *keys]
        weight = F.when(F.col("_children").isNull(), 1.0).otherwise(F.col("_child_weight"))
        rows = parents.join(children, by, "left").withColumns(
            {"_child_weight": weight, "_children": F.coalesce("_children", F.lit(1))}
        )
    else:
        rows = parents.selectExpr("*", "bigint(NULL) AS _child", "1.0D AS _child_weight", "1L AS _children")
    factor = {n: "_child_weight" if n in ("PI", "PR") else "_children" for n in names}
    return (
        rows.selectExpr(
            "level",
            REQUEST,
            *VIEW_KEYS,
            *attributes,
            "coalesce(_child, _instrument) AS instrument_id",
            "_instrument AS parent_instrument_id",
            "sub_portfolio_id",
            *[f"{n} * {factor[n]} AS {n}" for n in names],
        )
        .groupBy("level", REQUEST, *VIEW_KEYS, *attributes, *GROUP)
        .agg(
            *[_total(F.col(m)).alias(m) for m in METRICS],
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names if n in SHARES],
        )
    )


def scale_row(factors: DataFrame) -> DataFrame:
    """One row per (request, view) with the scale factor of each metric."""
    return factors.groupBy(REQUEST, *VIEW_KEYS).agg(
        *[
            F.max(
                F.when((F.col("container") == container) & (F.col("weight_label") == label), F.col("scale_factor"))
            ).alias(f"_scale_{metric}")
            for metric, (container, label) in SCALES.items()
        ]
    )


def value_columns(
    rows: DataFrame, assets: DataFrame | None = None, factors: DataFrame | None = None
) -> DataFrame:
    """Metrics as amounts: times total net assets and, if given, scale factors.

    ``assets`` has one row of totals, which every row gets, or one per request. Missing scale factors
    count as 1.
    """
    if assets is None:
        rows = rows.withColumns({c: F.lit(DEFAULT_ASSETS) for c in ASSETS.values()})
    elif REQUEST in assets.columns:
        rows = join_groups(rows, assets, [REQUEST])
    else:
        totals = assets.select(F.struct(*ASSETS.values())).scalar()
        rows = rows.withColumns({c: totals[c].cast("double") for c in ASSETS.values()})
    scales = {m: F.lit(1.0) for m in METRICS}
    if factors is not None:
        rows = join_groups(rows, scale_row(factors), [REQUEST, *VIEW_KEYS])
        scales = {m: F.coalesce(f"_scale_{m}", F.lit(1.0)) for m in METRICS}
    return rows.withColumns({f"{m}V": F.col(m) * F.col(ASSETS[m]) * scales[m] for m in METRICS}).drop(
        *[f"_scale_{m}" for m in METRICS]
    )


def normalize_columns(rows: DataFrame) -> DataFrame:
    """Divides each metric by its total in the view, its amount by the same number.

    The totals are stored first where the session has a folder for that: their size is
    then known, and rows of few views don't meet in as few tasks.
    """
    keys = [*present(rows, ["level"]), REQUEST, *VIEW_KEYS]
    totals = rows.groupBy(*keys).agg(*[_total(F.col(m)).alias(f"_total_{m}") for m in METRICS])
    joined = join_groups(rows, materialize_if_possible(totals), keys)
    columns = {}
    for m in METRICS:
        share = F.expr(f"CASE WHEN _total_{m} <> 0.0D THEN 1.0D / _total_{m} ELSE 1.0D END")
        columns[m] = F.col(m) * share
        if f"{m}V" in rows.columns:
            columns[f"{m}V"] = F.col(f"{m}V") * share
    return joined.withColumns(columns).drop(*[f"_total_{m}" for m in METRICS])


def small_to_zero(rows: DataFrame) -> DataFrame:
    return rows.withColumns({m: zero_if_tiny(F.col(m)) for m in METRICS})


def fill_null_nan(rows: DataFrame) -> DataFrame:
    names = present(rows, [*METRICS, *[f"{m}V" for m in METRICS]])
    return rows.withColumns({n: zero_if_missing(F.col(n)) for n in names})


def active_weights(rows: DataFrame) -> DataFrame:
    """Portfolio minus benchmark, as weights and as amounts."""
    weights = {
        "AIC": F.col("PI") - F.col("BC"),
        "ARC": F.col("PR") - F.col("BC"),
        "AIS": F.col("PI") - F.col("BS"),
        "ARS": F.col("PR") - F.col("BS"),
    }
    rows = rows.withColumns(weights)
    return rows.withColumns({f"{n}V": F.col(ASSETS["PI" if n[1] == "I" else "PR"]) * F.col(n) for n in weights})


def _finish(rows, assets, factors, scale_holdings: bool) -> DataFrame:
    rows = value_columns(rows, assets, factors if scale_holdings else None)
    if scale_holdings:
        rows = normalize_columns(rows)
    return active_weights(fill_null_nan(small_to_zero(rows)))


def portfolio_metrics(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    level: str,
    assets: DataFrame | None = None,
    factors: DataFrame | None = None,
    scale_holdings: bool = False,
    attributes: list[str] | None = None,
    child_weight: str = "raw",
) -> DataFrame:
    """All metrics of one level, by instrument, parent and sub-portfolio.

    """
    rows = grouped_exposures(positions, lookthroughs, level, attributes, child_weight)
    if scale_holdings:
        rows = materialize_if_possible(rows)
    return _finish(rows, assets, factors, scale_holdings)


def all_levels(
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    assets: DataFrame | None = None,
    factors: DataFrame | None = None,
    scale_holdings: bool = False,
    attributes: list[str] | None = None,
    child_weight: str = "raw",
) -> DataFrame:
    """The metrics of every level, tagged with it.

    The kept rows feed several sums, and the sums their own totals, so both are
    stored once where the session has a folder for that. Stored sums need the kept rows
    no more, and all steps up to them group by the instrument of the position: rows are
    dealt by it once.
    """
    levels = ["no"] if lookthroughs is None else list(LEVELS)
    labels = [out(w) for w in (*WEIGHTS, "weight")]
    own = present(positions, [REQUEST, *VIEW_KEYS, "container", "instrument_id", "sub_portfolio_id", *(attributes or [])])
    positions = positions.select(*own, *present(positions, [*labels, *SHARES]))
    if lookthroughs is not None:
        column = "weight" if child_weight == "raw" else out("weight")
        lookthroughs = lookthroughs.select(
            REQUEST, *VIEW_KEYS, "container", "record_type", "instrument_id", "parent_instrument_id",
            "sub_portfolio_id", column,
        )
    spark = positions.sparkSession
    if not scale_holdings or not shared_folder(spark):
        positions = materialize_if_possible(positions)
        lookthroughs = None if lookthroughs is None else materialize_if_possible(lookthroughs)
        return _finish(grouped_levels(positions, lookthroughs, levels, attributes, child_weight), assets, factors, scale_holdings)
    with ExitStack() as stored:
        kept = [None if f is None else stored.enter_context(stored_while(f)) for f in (positions, lookthroughs)]
        dealt = [
            None if f is None else f.repartition(REQUEST, *VIEW_KEYS, instrument, "sub_portfolio_id")
            for f, instrument in zip(kept, ("instrument_id", "parent_instrument_id"), strict=True)
        ]
        with settings(spark, DEALT):
            rows = materialize(grouped_levels(*dealt, levels, attributes, child_weight))
    # few, and small as a stored frame: the sums don't move to meet them
    factors = None if factors is None else materialize(factors)
    return _finish(rows, assets, factors, scale_holdings)


def drop_zero_weight_rows(rows: DataFrame, weights: list[str]) -> DataFrame:
    """Kept rows (``result`` true, where there is such a column) with a weight that is not 0.

    A missing weight is not 0.
    """
    kept = rows.where("result") if "result" in rows.columns else rows
    zero = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(w) == 0, F.lit(False)) for w in weights])
    return kept.where(~zero)
