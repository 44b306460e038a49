"""Which step removed a row: attribution, waterfall and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from foliolens.functions.criteria import literal
from foliolens.model import View, ViewSet
from foliolens.operators.factors import (
    Layout,
    bit,
    evaluate,
    preprocess_steps,
    rule_states,
    rule_steps,
    with_group_flags,
)
from foliolens.operators.lookthrough import parent_masks
from foliolens.operators.skew import join_groups
from foliolens.plans.reuse import materialize_if_possible
from foliolens.schema import PARENT_KEYS, REQUEST, ROW_KEYS, SPEC, VIEW_KEYS, present

PARENT_STEP = "parent_removed"
OUTPUT_STEP = "output"
SHARES = 32
"""Shares of a step's removed rows, for each row of a sample."""
STEP_KEYS = [REQUEST, *VIEW_KEYS, "step", "container", "record_type"]


def _states(schema: T.StructType, view: View) -> list[tuple[str, str, str]]:
    """Name, link and running outcome of every rule and postprocessing step."""
    states, chain = [], ""
    for position, link, criterion in rule_steps(schema, view):
        chain = f"({chain} {link.upper()} {criterion})" if chain else criterion
        states.append((f"rule_{position}", link, chain))
    states += [(m.name, m.operator or "and", outcome) for m, outcome in rule_states(schema, view) if m is not None]
    return states


def _steps(schema: T.StructType, view: View, with_parents: bool) -> tuple[list[str], str]:
    """Step names of a view and the number of the step that removed the row, else
    -1, or -2 less the number of the step that saved it.

    A preprocessing modifier is named by itself. Among rules it is the step at
    which the outcome turned false for good: in a chain of ANDs the first that
    fails. A kept row was saved by the step at which its outcome turned true for
    good, if it had been false; only steps linked by OR can do that.
    """
    before = preprocess_steps(schema, view)
    states = _states(schema, view)
    names = [m.name for m, _ in before] + [name for name, _, _ in states]
    whens = [f"WHEN {removed} THEN {i}" for i, (_, removed) in enumerate(before)]
    outcomes = ["true", *[outcome for _, _, outcome in states]]
    final = outcomes[-1]
    turns = [
        f"WHEN {outcomes[i]} AND NOT {outcomes[i + 1]} THEN {len(before) + i}" for i in reversed(range(len(states)))
    ]
    if turns:
        whens.append(f"WHEN NOT {final} THEN CASE {' '.join(turns)} END")
    if with_parents:
        names.append(PARENT_STEP)
        whens.append(f"WHEN NOT coalesce({bit(view, '_p')}, false) THEN {len(names) - 1}")
    whens += [
        f"WHEN NOT {outcomes[i]} AND {outcomes[i + 1]} THEN {-2 - len(before) - i}"
        for i in reversed(range(len(states)))
        if i and states[i][1] == "or"
    ]
    return names, f"CASE {' '.join(whens)} ELSE -1 END" if whens else "-1"


def _attributed(rows: DataFrame, views: ViewSet, carry: list[str], with_parents: bool) -> DataFrame:
    flagged = with_group_flags(rows, views)
    layout = Layout(views)
    steps = [_steps(flagged.schema, v, with_parents) for v in views.views]
    codes = ", ".join(f"int({code})" for _, code in steps)
    names = ", ".join(f"array({', '.join(map(literal, [*n, OUTPUT_STEP]))})" for n, _ in steps)
    sizes = layout.lookup([len(n) for n, _ in steps])
    columns = present(rows, list(dict.fromkeys([*ROW_KEYS, *carry])))
    specs = [v.spec for v in views.views]
    guard = [SPEC] if any(specs) and SPEC not in columns else []
    coded = flagged.selectExpr(*columns, *guard, f"posexplode(array({codes})) AS (_view, _code)")
    if any(specs):  # a row takes part in the views of its own specification only
        coded = coded.where(f"coalesce({layout.lookup(specs)} = {SPEC}, {layout.lookup(specs)} IS NULL)")
    return coded.selectExpr(
        *columns,
        f"{layout.lookup([v.config for v in views.views])} AS config",
        f"{layout.lookup([v.perspective_id for v in views.views])} AS perspective_id",
        f"array({names})[_view][int(CASE WHEN _code < 0 THEN {sizes} ELSE _code END)] AS step",
        f"CASE WHEN _code < -1 THEN array({names})[_view][int(-2 - _code)] END AS saved_by",
    )


def attributed_rows(
    positions: DataFrame, lookthroughs: DataFrame | None, views: ViewSet, carry: list[str] | None = None
) -> DataFrame:
    """Every (row, view) with the step that removed it, ``output`` where it was kept,
    and the step that saved a kept row (``saved_by``)."""
    carry = carry or []
    rows = _attributed(positions, views, carry, with_parents=False)
    if lookthroughs is None:
        return rows
    parents = parent_masks(evaluate(positions, views, []), views)
    children = join_groups(lookthroughs, parents, PARENT_KEYS)
    child_rows = _attributed(children, views, carry, with_parents=True)
    return rows.unionByName(child_rows, allowMissingColumns=True)


def step_attribution(
    positions: DataFrame, lookthroughs: DataFrame | None, views: ViewSet, carry: list[str] | None = None
) -> DataFrame:
    """Removed rows of every view with the step that removed them."""
    return attributed_rows(positions, lookthroughs, views, carry).where(F.col("step") != OUTPUT_STEP).drop("saved_by")


def waterfall(attributed: DataFrame, weights: list[str]) -> DataFrame:
    """Rows and weight that each step removed, and what is left, per container."""
    return attributed.groupBy(*STEP_KEYS).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in weights],
    )


def balance(attributed: DataFrame, weights: list[str], factors: DataFrame | None = None) -> DataFrame:
    """Rows and weight per container that came in, that each step removed or saved, and that are left.

    ``kind`` is ``input``, ``removed``, ``saved`` or ``output``; ``step`` names the steps of the middle
    ones. Input is what was removed and what is left; saved rows are among those left. Lines of
    ``output`` carry the container's scale factors by weight label. The rows are read once: all
    lines come from their sums per step.
    """
    keys = [REQUEST, *VIEW_KEYS, "container"]
    sums = [F.sum(w).alias(w) for w in weights]
    counts = attributed.groupBy(*STEP_KEYS, "saved_by").agg(F.count(F.lit(1)).alias("rows"), *sums)
    line = lambda kind, step: F.struct(F.lit(kind).alias("kind"), step.cast("string").alias("step"))
    left, none = F.col("step") == OUTPUT_STEP, F.lit(None)
    lines = F.array_compact(
        F.array(
            line("input", none),
            F.when(left, line("output", none)).otherwise(line("removed", F.col("step"))),
            F.when(F.col("saved_by").isNotNull(), line("saved", F.col("saved_by"))),
        )
    )
    unfolded = counts.select(*keys, "record_type", "rows", *weights, F.explode(lines).alias("line"))
    report = unfolded.groupBy(*keys, "record_type", "line.kind", "line.step").agg(
        F.sum("rows").alias("rows"), *[F.coalesce(F.sum(w), F.lit(0.0)).alias(w) for w in weights]
    )
    if factors is None:
        return report
    entry = F.struct("weight_label", "scale_factor")
    scales = factors.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("scale_factors"))
    joined = join_groups(report, scales, keys)
    return joined.withColumn("scale_factors", F.when(F.col("kind") == "output", F.col("scale_factors")))


def removed_samples(attributed: DataFrame, first: int, weight: str) -> DataFrame:
    """The heaviest removed rows of each step, and how many more there are.

    Removed rows are stored, with the few columns that samples show, so that they are
    attributed once. The heaviest rows of ``first`` of a step's shares weigh no more than
    its first rows, so that only rows which weigh as much are put in order.
    """
    removed = attributed.where(F.col("step") != OUTPUT_STEP).select(*STEP_KEYS, "identifier", "instrument_id", weight)
    removed = materialize_if_possible(removed)
    share = F.pmod(F.xxhash64("identifier", "instrument_id"), F.lit(SHARES * first)).alias("_share")
    shares = removed.groupBy(*STEP_KEYS, share).agg(F.count(F.lit(1)).alias("_n"), F.max(weight).alias("_heaviest"))
    heaviest = F.sort_array(F.collect_list("_heaviest"), asc=False)
    counts = shares.groupBy(*STEP_KEYS).agg(F.sum("_n").alias("_rows"), F.get(heaviest, F.lit(first - 1)).alias("_least"))
    order = Window.partitionBy(*STEP_KEYS).orderBy(F.col(weight).desc_nulls_last(), "identifier", "instrument_id")
    counts = materialize_if_possible(counts)  # its size is then known: mostly rows don't move to meet it
    heavy = join_groups(removed, counts, STEP_KEYS).where(F.col("_least").isNull() | (F.col(weight) >= F.col("_least")))
    top = heavy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.select(
        *STEP_KEYS,
        "rank",
        "identifier",
        weight,
        F.greatest(F.col("_rows") - first, F.lit(0)).alias("more"),
    )
