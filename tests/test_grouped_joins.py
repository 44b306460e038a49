"""Exposures meet their children in one join."""

from __future__ import annotations

import pytest

from foliolens.operators.metrics import grouped_levels

KEYS = "request_id string, config string, perspective_id bigint, container string"
WEIGHTS = "out_initial_exposure_weight double, out_resulting_exposure_weight double, out_weight double"
VIEW = ("r", "c", -1, "holding")
POSITIONS = [
    (*VIEW, 1, 5, 2.0, 4.0, None), (*VIEW, 1, 5, 1.0, None, None), (*VIEW, 2, 5, 8.0, 8.0, None), (*VIEW, None, 5, 16.0, None, None),
    (*VIEW, 3, None, 32.0, 1.0, None), (*VIEW, 4, 5, 64.0, 2.0, None),
]
CHILDREN = [
    (*VIEW, "essential_lookthroughs", 10, 1, 5, 0.5), (*VIEW, "essential_lookthroughs", 10, 1, 5, 0.25), (*VIEW, "essential_lookthroughs", None, 1, 5, 0.125),
    (*VIEW, "complete_lookthroughs", 11, 1, 5, 2.0), (*VIEW, "essential_lookthroughs", 12, 4, 5, None), (*VIEW, "essential_lookthroughs", 13, 9, 5, 1.0),
    (*VIEW, "essential_lookthroughs", 14, None, 5, 1.0), (*VIEW, "essential_lookthroughs", 14, 3, None, 1.0),
]
LEAVES = {("essential", 2, 2, 5): 8.0, ("essential", None, None, 5): 16.0, ("essential", 3, 3, None): 32.0}
ESSENTIAL = LEAVES | {("essential", 10, 1, 5): 2.25, ("essential", 1, 1, 5): 0.375, ("essential", 12, 4, 5): 0.0}
COMPLETE = {("complete", *key[1:]): value for key, value in LEAVES.items()} | {("complete", 11, 1, 5): 6.0, ("complete", 4, 4, 5): 64.0}


def frames(spark):
    positions = spark.createDataFrame(POSITIONS, f"{KEYS}, instrument_id bigint, sub_portfolio_id bigint, {WEIGHTS}")
    children = f"{KEYS}, record_type string, instrument_id bigint, parent_instrument_id bigint, sub_portfolio_id bigint, weight double"
    return positions, spark.createDataFrame(CHILDREN, children)


@pytest.mark.parametrize("levels,want", [(["essential"], ESSENTIAL), (["essential", "complete"], ESSENTIAL | COMPLETE)])
def test_children_and_leaves_come_from_one_join(spark, levels, want):
    """Also with missing keys, missing children and missing weights."""
    rows = grouped_levels(*frames(spark), levels)
    found = {(r["level"], r["instrument_id"], r["parent_instrument_id"], r["sub_portfolio_id"]): r["PI"] for r in rows.collect()}
    assert found == want
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
