"""Divisors of child groups: few bytes per group, and the same sums for groups with many masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolens.operators import rescale
from foliolens.operators.factors import evaluate
from foliolens.operators.rescale import child_totals
from foliolens.plans.pipeline import run_views
from foliolens.registry.inputs import rule, test as crit, view_set
from foliolens.schema import LOOKTHROUGH_KEYS
from tests.conftest import table

LOOK = "scale_lookthroughs_to_100_percent"
POSITION = "request_id string, container string, record_type string, identifier string, instrument_id long, parent_instrument_id long, sub_portfolio_id long, instrument_subtype_id int, trade_type_id long, liquidity_type_id long, weight double"


def _views(n=70):
    rules = {
        str(-i): {"rules": [rule(crit("liquidity_type_id", ">", i % 20)), rule(crit("liquidity_type_id", "<", i % 7 + 9), percent=50)]}
        for i in range(1, n + 1)
    }
    return view_set({"main": {p: [LOOK] for p in rules}}, rules)


def _frames(spark, children):
    base = {"request_id": "all", "container": "holding", "sub_portfolio_id": 1, "trade_type_id": 1, "liquidity_type_id": 99}
    pos = [{**base, "record_type": "positions", "identifier": f"p{i}", "instrument_id": i, "instrument_subtype_id": 27, "weight": 1.0} for i in (1, 2)]
    lt = [
        {**base, "record_type": "essential_lookthroughs", "identifier": f"c{i}", "instrument_id": 100 + i, "weight": None if i % 11 == 3 else float(i + 1),
         "parent_instrument_id": 1 if i < 3 else 2, "instrument_subtype_id": 1, "liquidity_type_id": i % 23}
        for i in range(children)
    ]
    return table(spark, pos, POSITION), table(spark, lt, POSITION)


def _expected(lt, vs):
    kept = {}
    for view in vs.views:
        n = -view.perspective_id
        for r in lt.collect():
            if r["liquidity_type_id"] > n % 20:
                factor = 0.5 if r["liquidity_type_id"] < n % 7 + 9 else 1.0
                kept[view.perspective_id, r["identifier"]] = (r["parent_instrument_id"], r["weight"], factor)
    sums = {}
    for (pid, _), (parent, weight, factor) in kept.items():
        sums[pid, parent] = sums.get((pid, parent), 0.0) + (weight or 0.0) * factor
    return {
        key: None if weight is None else round(weight * (factor / sums[key[0], parent] if sums[key[0], parent] else factor), 9)
        for key, (parent, weight, factor) in kept.items()
    }


def _found(frame):
    return {(r["perspective_id"], r["identifier"]): r["w"] for r in frame.select("perspective_id", "identifier", F.round("out_weight", 9).alias("w")).collect()}


def test_groups_of_few_and_of_many_masks_are_rescaled_alike(spark, monkeypatch):
    pos, lt = _frames(spark, 60)
    vs = _views()
    expected = _expected(lt, vs)
    assert _found(run_views(pos, lt, vs).lookthroughs) == expected  # the second parent has more masks than MASKS
    for bound in (0, 1000):
        monkeypatch.setattr(rescale, "MASKS", bound)
        assert _found(run_views(pos, lt, vs).lookthroughs) == expected


def test_totals_of_a_small_group_do_not_grow_with_the_views(spark):
    _, lt = _frames(spark, 3)
    lt = lt.withColumn("liquidity_type_id", F.lit(99))  # kept by all views
    sizes = []
    for n in (10, 60):
        vs = _views(n)
        totals = child_totals(evaluate(lt, vs, ["weight"]), vs, ["weight"]).drop(*LOOKTHROUGH_KEYS)
        sizes.append(len(totals.select(F.to_json("_children")).first()[0]))
    assert sizes[1] < sizes[0] + 200
