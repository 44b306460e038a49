"""Rescaling of kept weights to 100 percent, per container and per parent."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from foliolens.functions.criteria import CriteriaCompiler, literal
from foliolens.model import View, ViewSet
from foliolens.operators.factors import BITS, Layout, explode_views, pack
from foliolens.operators.lookthrough import intersect_masks, parent_masks
from foliolens.operators.skew import join_groups
from foliolens.schema import (
    ESSENTIAL,
    GROUP_KEYS,
    LOOKTHROUGH_KEYS,
    PARENT_KEYS,
    REQUEST,
    VIEW_KEYS,
    out,
    present,
)

TOTAL = -1
"""View number under which raw totals are kept."""
MASKS = 16
"""Distinct masks up to which a group of children keeps their sums, in place of sums per view."""


def _wanted_bits(layout: Layout, wanted: list[View]) -> list[str]:
    """Mask and scale columns with what the wanted views need of them."""
    used = {v.index // BITS: 0 for v in wanted}
    for v in wanted:
        used[v.index // BITS] |= 1 << (v.index % BITS)
    scales = {layout.scale_name[v.index] for v in wanted if v.index in layout.scale_name}
    masks = [f"{f'{m} & {used[w]}L' if w in used else '0L'} AS {m}" for w, m in enumerate(layout.masks)]
    return masks + [f"{s if s in scales else '1.0D'} AS {s}" for s in layout.scales]


def _sums(frame: DataFrame, labels: list[str], layout: Layout, wanted: list[View], positions: bool) -> DataFrame:
    """Weights of a frame in the common shape of the mass aggregation.

    Only the mask bits and scale columns of the wanted views are left, to keep
    the number of distinct masks low.
    """
    return frame.selectExpr(
        *GROUP_KEYS,
        f"{literal(positions)} AS _positions",
        *_wanted_bits(layout, wanted),
        *[f"double({f'`{w}`' if w in frame.columns else 'NULL'}) AS `{w}`" for w in labels],
    )


def group_masses(positions: DataFrame, essential: DataFrame | None, views: ViewSet, labels: list[str]) -> DataFrame:
    """Kept mass per (request, container, view) and raw totals as view -1.

    Both frames are evaluated; ``essential`` has all essential child rows, also
    the removed ones, with their masks in step with their parents. Rows are
    first summed per distinct mask, so the cost of the scan does not grow with
    the number of views; the sums per mask are then spread over views.
    """
    layout = Layout(views)
    wanted = [v for v in views.views if v.rescales_holdings]
    rows = _sums(positions, labels, layout, wanted, True)
    if essential is not None and present(essential, labels):
        rows = rows.unionByName(_sums(essential, labels, layout, wanted, False))
    by_mask = rows.groupBy(*GROUP_KEYS, "_positions", *layout.masks, *layout.scales).agg(
        *[F.sum(w).alias(w) for w in labels]
    )
    numbers = ", ".join(str(n) for n in [TOTAL, *[v.index for v in wanted]])
    used = f"view = {TOTAL} OR {layout.has_bit('view')}"
    factor = f"CASE WHEN view = {TOTAL} THEN 1.0D ELSE {layout.scale_of('greatest(view, 0)')} END"
    return (
        by_mask.withColumn("view", F.expr(f"explode(array({numbers}))"))
        .where(used)
        .withColumn("_factor", F.expr(factor))
        .groupBy(*GROUP_KEYS, "view")
        .agg(
            F.max("_positions").alias("_positions"),
            *[F.coalesce(F.sum(F.col(w) * F.col("_factor")), F.lit(0.0)).alias(w) for w in labels],
        )
    )


def raw_totals(positions: DataFrame, lookthroughs: DataFrame | None, labels: list[str]) -> DataFrame:
    """Sum of each weight over all rows of a container, essential children included."""
    parts = [positions.select(*GROUP_KEYS, F.lit(True).alias("_positions"), *labels)]
    if lookthroughs is not None and present(lookthroughs, labels):
        parts.append(
            lookthroughs.where(F.col("record_type") == ESSENTIAL).select(
                *GROUP_KEYS,
                F.lit(False).alias("_positions"),
                *[(F.col(w) if w in lookthroughs.columns else F.lit(None)).cast("double").alias(w) for w in labels],
            )
        )
    return (
        functools.reduce(DataFrame.unionByName, parts)
        .groupBy(*GROUP_KEYS)
        .agg(F.max("_positions").alias("_positions"), *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in labels])
        .where("_positions")
        .drop("_positions")
    )


def mass_index(views: ViewSet, labels: list[str]) -> dict[tuple[int, str], int]:
    order = [TOTAL, *[v.index for v in views.views if v.rescales_holdings]]
    return {(view, w): i * len(labels) + j for i, view in enumerate(order) for j, w in enumerate(labels)}


def pack_masses(masses: DataFrame, views: ViewSet, labels: list[str]) -> DataFrame:
    """One row per (request, container) with the masses as an array.

    The array has one slot per (view, label); a group has at most one row per
    view, so what is gathered is bounded by the settings of the run.
    """
    order = [TOTAL, *[v.index for v in views.views if v.rescales_holdings]]
    by_view = F.map_from_entries(
        F.collect_list(F.struct(F.col("view"), F.array(*[F.col(w) for w in labels]).alias("sums")))
    )
    zeros = F.array(*[F.lit(0.0) for _ in labels])
    return (
        masses.groupBy(*GROUP_KEYS)
        .agg(by_view.alias("_by_view"), F.max("_positions").alias("_positions"))
        .where("_positions")
        .select(
            *GROUP_KEYS,
            F.flatten(
                F.transform(
                    F.array(*[F.lit(v) for v in order]),
                    lambda v: F.coalesce(F.element_at("_by_view", v), zeros),
                )
            ).alias("_masses"),
        )
    )


def container_masses(positions: DataFrame, essential: DataFrame | None, views: ViewSet, labels: list[str]) -> DataFrame:
    """Packed masses of evaluated frames, summed by distinct mask however many views there are."""
    return pack_masses(group_masses(positions, essential, views, labels), views, labels)


@dataclass(frozen=True)
class Totals:
    """Where the divisors of a (view, label) stand."""

    array: str
    offsets: dict[int, int] | None
    """Places in an array of all views' divisors; without them the column is a struct made by ``child_totals``."""
    match: str | None = None
    """Prefix of the mask of views for which a row is rescaled."""
    layout: Layout | None = None

    def place(self, view: int, label: int) -> str | None:
        """The divisor of a view and label; None where there is none."""
        if self.offsets is None:
            return self.of_group(str(view), label)
        return f"{self.array}[{self.offsets[view] + label}]" if view in self.offsets else None

    def of_group(self, number: str, label: int) -> str:
        """The divisor of a view number: from the sums per view, if the group has them, else from those per mask."""
        kept = f"{self.layout.has_bit(number, 'p._m')} AND p.sums[{label}] IS NOT NULL"
        added = f"t + if({kept}, p.sums[{label}] * {self.layout.scale_of(number, 'p.')}, 0.0D)"
        by_mask = f"aggregate({self.array}.by_mask, 0.0D, (t, p) -> {added})"
        return f"if({self.array}.by_view IS NULL, {by_mask}, {self.array}.by_view[int({number})][{label}])"


def weigh(evaluated: DataFrame, views: ViewSet, labels: list[str], totals: Totals | None, carry: list[str]) -> DataFrame:
    """Kept rows per view with output weights: weight times factor.

    With ``totals`` the factor is divided by the total of the row's group where
    there is one and it is not zero.
    """
    extra = {}
    if totals is not None:
        layout = Layout(views)
        matched = f" AND {layout.has_bit(prefix=totals.match)}" if totals.match else ""
        offset = "" if totals.offsets is None else layout.lookup([totals.offsets.get(v.index, -1) for v in views.views])
        applies = f"true{matched}" if totals.offsets is None else f"{offset} >= 0L{matched}"
        for j, w in enumerate(labels):
            place = totals.of_group("_view", j) if totals.offsets is None else f"{totals.array}[int({offset}) + {j}]"
            extra[f"_t_{w}"] = f"CASE WHEN {applies} THEN {place} END"
    long = explode_views(evaluated, views, carry, extra)
    divided = "CASE WHEN coalesce(_t_{w}, 0.0D) <> 0.0D THEN factor / _t_{w} ELSE factor END"
    return long.selectExpr(
        *[f"`{c}`" for c in carry],
        *VIEW_KEYS,
        "factor",
        *[f"`{w}` * {divided.format(w=w) if extra else 'factor'} AS `{out(w)}`" for w in labels],
    )


def weigh_positions(
    positions: DataFrame,
    views: ViewSet,
    labels: list[str],
    packed: DataFrame | None,
    carry: list[str],
) -> DataFrame:
    """Positions per view; containers of rescaling views sum to 100 percent."""
    if packed is None:
        return weigh(positions, views, labels, None, carry)
    joined, totals = with_container_totals(positions, views, labels, packed)
    return weigh(joined, views, labels, totals, carry)


def with_container_totals(
    positions: DataFrame, views: ViewSet, labels: list[str], packed: DataFrame
) -> tuple[DataFrame, Totals]:
    """Evaluated positions with the masses of their container, and where they stand."""
    index = mass_index(views, labels)
    offsets = {view: i for (view, w), i in index.items() if view != TOTAL and w == labels[0]}
    joined = join_groups(positions, packed, GROUP_KEYS)
    return joined, Totals("_masses", offsets)


def matching_parents(positions: DataFrame, views: ViewSet) -> DataFrame | None:
    """Per instrument: the views in which its children are to be rescaled.

    The criterion is read on positions of any container and sub-portfolio. None
    when there is no criterion: all parents match.
    """
    criteria = views.lookthrough_criteria
    if not criteria:
        return None
    layout = Layout(views)
    flags = {
        v.index: CriteriaCompiler(positions.schema, v.perspective_id).sql(criteria)
        for v in views.views
        if v.rescales_lookthroughs
    }
    names = [f"_q{w}" for w in range(layout.words)]
    return (
        positions.select(
            REQUEST,
            F.col("instrument_id").alias("parent_instrument_id"),
            *[pack(flags, w).alias(n) for w, n in enumerate(names)],
        )
        .where(layout.any_kept("_q"))
        .groupBy(REQUEST, "parent_instrument_id")
        .agg(*[F.bit_or(n).alias(n) for n in names])
    )


def child_totals(lookthroughs: DataFrame, views: ViewSet, labels: list[str]) -> DataFrame:
    """Kept mass per (parent, record type): the sums of all labels per distinct mask, or per view.

    All rows of such a group share their parent, so the sums can be taken before
    the parents are known: the group later stays or goes as a whole. A group has
    few distinct masks as a rule, and their sums are all that is kept of it: its
    size doesn't grow with the views. One with more than ``MASKS`` of them has a
    map of views to sums in their place, which its many masks outweigh.
    """
    layout = Layout(views)
    wanted = [v for v in views.views if v.rescales_lookthroughs]
    kept = lookthroughs.where(layout.any_kept()).selectExpr(*LOOKTHROUGH_KEYS, *_wanted_bits(layout, wanted), *[f"`{w}`" for w in labels])
    by_mask = kept.groupBy(*LOOKTHROUGH_KEYS, *layout.masks, *layout.scales).agg(*[F.sum(w).alias(w) for w in labels])
    numbers = f"array({', '.join(str(v.index) for v in wanted)})"
    counted = by_mask.withColumn("_few", F.count(F.lit(1)).over(Window.partitionBy(*LOOKTHROUGH_KEYS)) <= MASKS)
    spread = (
        counted.withColumn("view", F.expr(f"explode(if(_few, array({TOTAL}), {numbers}))"))
        .where(f"_few OR {layout.has_bit('greatest(view, 0)')}")
        .withColumn("_factor", F.expr(f"CASE WHEN _few THEN 1.0D ELSE {layout.scale_of('greatest(view, 0)')} END"))
        .selectExpr(
            *LOOKTHROUGH_KEYS,
            "view",
            *[f"if(_few, {m}, 0L) AS {m}" for m in layout.masks],
            *[f"if(_few, {s}, 1.0D) AS {s}" for s in layout.scales],
            *[f"`{w}` * _factor AS `{w}`" for w in labels],
        )
        .groupBy(*LOOKTHROUGH_KEYS, "view", *layout.masks, *layout.scales)
        .agg(F.array(*[F.sum(w) for w in labels]).alias("sums"))
    )
    of_mask = F.when(F.col("view") == TOTAL, F.struct(*layout.masks, *layout.scales, "sums"))
    of_view = F.when(F.col("view") != TOTAL, F.struct("view", "sums"))
    groups = spread.groupBy(*LOOKTHROUGH_KEYS).agg(F.collect_list(of_mask).alias("by_mask"), F.collect_list(of_view).alias("_by_view"))
    by_view = F.expr("if(size(_by_view) > 0, map_from_entries(_by_view), NULL)").alias("by_view")
    return groups.select(*LOOKTHROUGH_KEYS, F.struct("by_mask", by_view).alias("_children"))


def sync_and_rescale_lookthroughs(
    lookthroughs: DataFrame,
    positions: DataFrame,
    raw_positions: DataFrame,
    views: ViewSet,
    labels: list[str],
    keep_removed: bool = False,
) -> tuple[DataFrame, Totals]:
    """Synced child rows with the totals of their parents, in one join of the rows.

    Parents and their match flags are put together first, then both with the totals
    of each group. Returns the rows and where the divisors stand.
    """
    layout = Layout(views)
    parents = parent_masks(positions, views)
    matches = matching_parents(raw_positions, views)
    if matches is not None:
        parents = join_groups(parents, matches, [REQUEST, "parent_instrument_id"])
    groups = join_groups(child_totals(lookthroughs, views, labels), parents, PARENT_KEYS, "inner")
    if keep_removed:
        rows = intersect_masks(join_groups(lookthroughs, groups, LOOKTHROUGH_KEYS), views)
    else:
        alive = lookthroughs.where(layout.any_kept())
        joined = join_groups(alive, groups, LOOKTHROUGH_KEYS, "inner")
        rows = intersect_masks(joined, views).where(layout.any_kept())
    return rows, Totals("_children", None, None if matches is None else "_q", layout)
