"""Share of the original mass that a view keeps, per container and label."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from foliolens.functions.criteria import literal
from foliolens.model import ViewSet
from foliolens.operators.factors import Layout
from foliolens.operators.rescale import TOTAL, mass_index, raw_totals
from foliolens.schema import ESSENTIAL, GROUP_KEYS, REQUEST, SPEC, VIEW_KEYS, present

SCALE_COLUMNS = [REQUEST, "config", "perspective_id", "container", "weight_label", "scale_factor"]


def kept_share(kept: Column, total: Column) -> Column:
    """NULL without mass, 1 when nothing is kept, else the kept share."""
    return F.when(total == 0.0, F.lit(None)).when(kept == 0.0, F.lit(1.0)).otherwise(F.try_divide(kept, total))


def _grid(rows: DataFrame, views: ViewSet, labels: list[str], rescaling_only: bool) -> DataFrame:
    """Each (request, container) with its views and weight labels.

    Adds ``_view``, ``_label`` (numbers), config, perspective and label name. A
    container has the labels given for it, a request the views of its own
    specification.
    """
    layout = Layout(views)
    numbers = [v.index for v in views.views if v.rescales_holdings or not rescaling_only]
    own = []
    for spec, containers in views.labels.items():
        for container, (names, _) in containers.items():
            wanted = [w for w in labels if w in (names or [])]
            if wanted:
                of_spec = "" if spec is None else f" AND {SPEC} = {literal(spec)}"
                own.append(f"(container = {literal(container)} AND weight_label IN ({', '.join(map(literal, wanted))}){of_spec})")
    if any(v.spec is not None for v in views.views):
        of_view = f" AND {layout.lookup([v.spec for v in views.views])} = {SPEC}"
    else:
        of_view = ""
    return (
        rows.withColumn("_view", F.expr(f"explode(cast(array({', '.join(map(str, numbers))}) AS array<int>))"))
        .withColumn("_label", F.expr(f"explode(sequence(0, {len(labels) - 1}))"))
        .withColumn("weight_label", F.expr(layout.lookup(labels, "_label")))
        .where(f"({' OR '.join(own) or 'false'}){of_view}")
        .withColumn("config", F.expr(layout.lookup([v.config for v in views.views])))
        .withColumn("perspective_id", F.expr(layout.lookup([v.perspective_id for v in views.views])))
    )


def scale_factors(packed: DataFrame, views: ViewSet, labels: list[str], specs: DataFrame | None = None) -> DataFrame:
    """Scale factors of the views that rescale holdings, from packed masses.

    ``specs`` maps requests to specifications in batches of several.
    """
    index = mass_index(views, labels)
    layout = Layout(views)
    offsets = [index.get((v.index, labels[0]), 0) for v in views.views]
    rows = packed if specs is None else packed.join(specs, REQUEST)
    kept = F.expr(f"_masses[int({layout.lookup(offsets)}) + _label]")
    total = F.expr(f"_masses[{index[(TOTAL, labels[0])]} + _label]")
    return _grid(rows, views, labels, True).withColumn("scale_factor", kept_share(kept, total)).select(*SCALE_COLUMNS)


def complete_scale_factors(
    containers: DataFrame,
    computed: DataFrame | None,
    views: ViewSet,
    labels: list[str],
    specs: DataFrame | None = None,
) -> DataFrame:
    """Scale factors of all views: 1 where none was computed, left out where it is NULL.

    ``containers`` lists the (request, container) pairs present in the positions.
    """
    rows = containers if specs is None else containers.join(specs, REQUEST)
    if not labels:
        empty = "'' AS config", "0L AS perspective_id", "'' AS weight_label", "1.0D AS scale_factor"
        return containers.selectExpr(*GROUP_KEYS, *empty).select(*SCALE_COLUMNS).where("false")
    grid = _grid(rows, views, labels, False).withColumn("scale_factor", F.lit(1.0)).select(*SCALE_COLUMNS)
    if computed is None:
        return grid
    known = computed.select(*SCALE_COLUMNS[:-1], F.col("scale_factor").alias("_computed"), F.lit(True).alias("_known"))
    return (
        grid.join(known, SCALE_COLUMNS[:-1], "left")
        .withColumn("scale_factor", F.when(F.col("_known"), F.col("_computed")).otherwise(F.col("scale_factor")))
        .where(F.col("scale_factor").isNotNull())
        .select(*SCALE_COLUMNS)
    )


def scale_factors_from_result(
    raw_positions: DataFrame,
    raw_lookthroughs: DataFrame | None,
    positions: DataFrame,
    lookthroughs: DataFrame | None,
    views: ViewSet,
    labels: list[str],
) -> DataFrame:
    """Scale factors recomputed from finished factor rows, as a cross-check.

    Views with no kept row in a container count as 1, as in ``scale_factors``.
    """
    keys = [*GROUP_KEYS, *VIEW_KEYS]
    parts = [positions.select(*keys, *[(F.col(w) * F.col("factor")).alias(w) for w in labels])]
    if lookthroughs is not None and present(lookthroughs, labels):
        parts.append(
            lookthroughs.where(F.col("record_type") == ESSENTIAL).select(
                *keys,
                *[
                    (F.col(w) * F.col("factor") if w in lookthroughs.columns else F.lit(None)).cast("double").alias(w)
                    for w in labels
                ],
            )
        )
    kept = functools.reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(w).alias(w) for w in labels])
    totals = raw_totals(raw_positions, raw_lookthroughs, labels)

    def long(frame: DataFrame, by: list[str], name: str) -> DataFrame:
        return frame.unpivot(by, labels, "weight_label", name)

    grid = _grid(totals.select(*GROUP_KEYS), views, labels, True).drop("_view", "_label")
    return (
        grid.join(long(totals, GROUP_KEYS, "_total"), [*GROUP_KEYS, "weight_label"], "left")
        .join(long(kept, keys, "_mass"), [*keys, "weight_label"], "left")
        .withColumn("scale_factor", kept_share(F.coalesce("_mass", F.lit(0.0)), F.col("_total")))
        .select(*SCALE_COLUMNS)
    )


def unpivot_scale_factors(wide: DataFrame, prefix: str = "sf__") -> DataFrame:
    """Long rows from columns ``sf__<config>__<perspective>__<label>``.

    The perspective is the last number between double underscores, so config
    names and labels are free.
    """
    columns = [c for c in wide.columns if c.startswith(prefix)]
    keys = [c for c in wide.columns if c not in columns]
    pattern = "^" + prefix + "(.*)__(-?[0-9]+)__(.*)$"
    return wide.unpivot(keys, columns, "_name", "scale_factor").select(
        *keys,
        F.regexp_extract("_name", pattern, 1).alias("config"),
        F.regexp_extract("_name", pattern, 2).cast("long").alias("perspective_id"),
        F.regexp_extract("_name", pattern, 3).alias("weight_label"),
        "scale_factor",
    )
