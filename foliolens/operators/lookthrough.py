"""Child rows in step with their parent positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliolens.model import ViewSet
from foliolens.operators.factors import Layout
from foliolens.operators.skew import join_groups
from foliolens.schema import PARENT_KEYS, REQUEST, VIEW_KEYS


def parent_masks(positions: DataFrame, views: ViewSet) -> DataFrame:
    """One row per parent key with the views that keep any position of that key."""
    layout = Layout(views)
    return (
        positions.where(layout.any_kept())
        .select(
            REQUEST,
            "container",
            F.col("instrument_id").alias("parent_instrument_id"),
            "sub_portfolio_id",
            *[F.col(m).alias(f"_p{w}") for w, m in enumerate(layout.masks)],
        )
        .groupBy(*PARENT_KEYS)
        .agg(*[F.bit_or(f"_p{w}").alias(f"_p{w}") for w in range(layout.words)])
    )


def intersect_masks(rows: DataFrame, views: ViewSet) -> DataFrame:
    """Own mask and parent mask."""
    layout = Layout(views)
    own = {m: F.expr(f"{m} & coalesce(_p{w}, 0L)") for w, m in enumerate(layout.masks)}
    return rows.withColumns(own).drop(*[f"_p{w}" for w in range(layout.words)])


def sync_lookthroughs(
    lookthroughs: DataFrame,
    positions: DataFrame,
    views: ViewSet,
    keep_removed: bool = False,
) -> DataFrame:
    """Removes child rows from the views that removed their parent.

    Both frames are evaluated. A child without a parent row is removed, a child
    of several positions with one key stays if any of them stays. The parents'
    scale factors are not inherited. Rows that no view keeps are dropped unless
    ``keep_removed`` is set.
    """
    layout = Layout(views)
    parents = parent_masks(positions, views)
    if keep_removed:
        return intersect_masks(join_groups(lookthroughs, parents, PARENT_KEYS, "left"), views)
    alive = lookthroughs.where(layout.any_kept())
    joined = join_groups(alive, parents, PARENT_KEYS, "inner")
    return intersect_masks(joined, views).where(layout.any_kept())


def sync_factor_rows(lookthroughs: DataFrame, positions: DataFrame) -> DataFrame:
    """The same on long factor rows, for frames that were stored per view."""
    parents = (
        positions.where(F.col("factor").isNotNull())
        .select(
            REQUEST,
            *VIEW_KEYS,
            "container",
            F.col("instrument_id").alias("parent_instrument_id"),
            "sub_portfolio_id",
        )
        .distinct()
    )
    return lookthroughs.join(parents, [*PARENT_KEYS, *VIEW_KEYS], "left_semi")


def expand_lookthroughs(
    positions: DataFrame,
    lookthroughs: DataFrame,
    record_type: str,
    child_columns: dict[str, str],
) -> DataFrame:
    """Drill-down: each kept position with its kept children of one record type.

    Both are long factor rows. ``child_columns`` maps child columns to their new
    names; leaf positions have NULL there. Written as matches plus leaves, both
    of which adaptive execution can split when one parent has most children.
    """
    keys = [REQUEST, *VIEW_KEYS, "container", "_instrument", "sub_portfolio_id"]
    children = lookthroughs.where(F.col("record_type") == record_type).select(
        REQUEST,
        *VIEW_KEYS,
        "container",
        F.col("parent_instrument_id").alias("_instrument"),
        "sub_portfolio_id",
        *[F.col(c).alias(n) for c, n in child_columns.items()],
    )
    keyed = positions.withColumn("_instrument", F.col("instrument_id"))
    matched = children.join(keyed, keys, "inner")
    leaves = keyed.join(children.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(leaves, allowMissingColumns=True).drop("_instrument")
