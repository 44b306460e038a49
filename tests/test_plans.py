"""What the physical plans do at scale, and results under heavy skew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliolens.functions.criteria import where_criteria
from foliolens.model import Modifier
from foliolens.operators.audit import removed_samples
from foliolens.operators.factors import evaluate, factors
from foliolens.operators.lookthrough import parent_masks, sync_lookthroughs
from foliolens.operators.metrics import exposure_metrics, group_exposures, grouped_exposures
from foliolens.operators.output import write_colocated
from foliolens.plans.pipeline import run_views
from foliolens.registry.audit_queries import _attributed
from foliolens.registry.inputs import lookthroughs, positions, rule, test as crit, view_set
from foliolens.registry.view_queries import CRITERIA_RULES, HOLD, main, views

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(where_criteria(df, crit("o_orderstatus", "==", "F")).select("o_orderkey"))
    assert "EqualNullSafe(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_no_cross_joins_and_no_window_over_containers(spark):
    result = main(spark, SF, HOLD)
    for frame in (result.positions, result.lookthroughs, result.all_scale_factors):
        text = plan(frame)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Window" not in text


def test_number_of_scans_does_not_grow_with_views(spark):
    def scans(n):
        rules = {str(-i): {"rules": [rule(crit("trade_type_id", "<=", i % 5 + 1))]} for i in range(1, n + 1)}
        vs = view_set({"main": {p: [HOLD] for p in rules}}, rules)
        result = run_views(positions(spark, SF), lookthroughs(spark, SF), vs, reuse="plan")
        return plan(result.positions).split("== Physical Plan ==")[-1].count("FileScan parquet")

    assert scans(2) == scans(70)


def test_more_views_than_one_mask_word(spark):
    rules = {str(-i): {"rules": [rule(crit("liquidity_type_id", "==", i % 9))]} for i in range(1, 131)}
    vs = view_set({"main": {p: [HOLD] for p in rules}}, rules)
    result = run_views(positions(spark, SF), lookthroughs(spark, SF), vs)
    found = {r["perspective_id"]: r["n"] for r in result.positions.groupBy("perspective_id").agg(F.count("*").alias("n")).collect()}
    raw = {r["liquidity_type_id"]: r["n"] for r in positions(spark, SF).groupBy("liquidity_type_id").agg(F.count("*").alias("n")).collect()}
    assert found == {-i: raw[i % 9] for i in range(1, 131) if i % 9}
    share = result.positions.where("container = 'holding'").groupBy("perspective_id").agg(F.sum("out_initial_weight").alias("s"))
    assert all(0 < r["s"] <= 1 + 1e-9 for r in share.collect())


def test_rank_limit_runs_before_the_shuffle(spark):
    text = plan(removed_samples(_attributed(spark, SF), 3, "initial_weight"))
    assert "WindowGroupLimit" in text


def test_plans_without_any_broadcast_give_the_same(spark):
    columns = ["perspective_id", "identifier", "out_initial_weight"]
    usual = rows(run_views(positions(spark, SF), None, views(HOLD), reuse="plan").positions, *columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = run_views(positions(spark, SF), None, views(HOLD), reuse="plan")
        assert "BroadcastHashJoin" not in plan(result.positions)
        assert rows(result.positions, *columns) == usual
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def skewed(spark):
    """One position has most children, and is there several times."""
    pos, lt = positions(spark, SF), lookthroughs(spark, SF)
    top = pos.where("container = 'holding'").orderBy("instrument_id").limit(1).first()
    hot = {c: F.lit(top[c]) for c in ("container", "sub_portfolio_id")}
    lt = lt.withColumns({c: F.when(F.col("instrument_id") % 3 > 0, v).otherwise(F.col(c)) for c, v in hot.items()})
    lt = lt.withColumn(
        "parent_instrument_id",
        F.when(F.col("instrument_id") % 3 > 0, F.lit(top["instrument_id"])).otherwise(F.col("parent_instrument_id")),
    )
    again = pos.where(F.col("instrument_id") == top["instrument_id"])
    return pos.unionByName(again).unionByName(again), lt


def test_both_ways_to_keep_children_in_step(spark):
    pos, lt = skewed(spark)
    vs = views()
    pos_eval, lt_eval = evaluate(pos, vs, ["weight"]), evaluate(lt, vs, ["weight"])
    columns = ["identifier", "instrument_id", "_m0"]
    kept = sync_lookthroughs(lt_eval, pos_eval, vs, keep_removed=True).where("_m0 <> 0")
    assert rows(sync_lookthroughs(lt_eval, pos_eval, vs), *columns) == rows(kept, *columns)
    assert "CartesianProduct" not in plan(sync_lookthroughs(lt_eval, pos_eval, vs))


def test_presummed_metrics_equal_row_level_metrics_with_duplicates(spark):
    pos, lt = skewed(spark)
    r = run_views(pos, lt, views(), carry=["initial_shares"])
    for level in ("no", "essential", "complete"):
        direct = group_exposures(exposure_metrics(r.positions, r.lookthroughs, level))
        columns = sorted(direct.columns)
        fused = grouped_exposures(r.positions, r.lookthroughs, level)

        def plain(df):
            return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in df.select(columns).collect())

        assert plain(direct) == plain(fused)


def test_group_saviour_with_a_huge_group_of_missing_keys(spark):
    pos = positions(spark, SF).withColumn(
        "simulated_trade_id", F.when(F.col("instrument_id") % 2 == 0, F.lit(-2147483648)).otherwise(F.col("simulated_trade_id"))
    )
    post = crit("simulated_trade_id", "In", {"table_name": "rule_result", "column": "result", "operator_type": "==", "value": True})
    modifiers = {"m": Modifier("m", "PostProcessing", post, "both", "or")}
    vs = view_set({"c": {"-1": ["m"]}}, {"-1": {"rules": [rule(crit("liquidity_type_id", "==", 4))]}}, modifiers=modifiers)
    data = pos.select("identifier", "simulated_trade_id", "liquidity_type_id").collect()
    passing = {r["simulated_trade_id"] for r in data if r["liquidity_type_id"] == 4}
    expected = sorted(r["identifier"] for r in data if r["simulated_trade_id"] in passing)
    assert sorted(r["identifier"] for r in factors(pos, vs).select("identifier").collect()) == expected
    text = plan(factors(pos, vs))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_stored_and_recomputed_frames_agree(spark):
    columns = ["perspective_id", "identifier", "instrument_id", "factor", "out_weight"]
    pos, lt = positions(spark, SF), lookthroughs(spark, SF)
    one = run_views(pos, lt, views(HOLD), reuse="plan")
    two = run_views(pos, lt, views(HOLD), reuse="all")
    assert rows(one.positions, *columns) == rows(two.positions, *columns)
    assert rows(one.lookthroughs, *columns) == rows(two.lookthroughs, *columns)
    with pytest.raises(ValueError, match="reuse"):
        run_views(pos, lt, views(HOLD), reuse="cache")


def test_bucketed_tables_join_without_a_shuffle(spark):
    write_colocated(positions(spark, SF), lookthroughs(spark, SF), ("bucketed_pos", "bucketed_lt"), 4)
    vs = views()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pos, lt = spark.table("bucketed_pos"), spark.table("bucketed_lt")
        synced = sync_lookthroughs(evaluate(lt, vs, []), evaluate(pos, vs, []), vs)
        physical = plan(synced).split("== Physical Plan ==")[-1]
        assert "Exchange" not in physical
        plain = sync_lookthroughs(evaluate(lookthroughs(spark, SF), vs, []), evaluate(positions(spark, SF), vs, []), vs)
        assert synced.count() == plain.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bucketed_pos")
        spark.sql("DROP TABLE bucketed_lt")


def test_rescaled_weights_sum_to_one(spark):
    """Positions plus kept essential mass over the divisor make 1 per container."""
    result = main(spark, SF, HOLD)
    shares = result.positions.groupBy("perspective_id", "container").agg(F.sum("out_resulting_weight").alias("s"))
    kept = result.positions.groupBy("perspective_id", "container").agg(F.sum(F.expr("resulting_weight * factor")).alias("p"))
    essential = (
        result.lookthroughs.where("record_type = 'essential_lookthroughs'")
        .groupBy("perspective_id", "container")
        .agg(F.sum(F.expr("resulting_weight * factor")).alias("c"))
    )
    joined = shares.join(kept, ["perspective_id", "container"]).join(essential, ["perspective_id", "container"], "left")
    for r in joined.collect():
        c = r["c"] or 0.0
        assert r["s"] + c / (r["p"] + c) == pytest.approx(1.0)


@pytest.mark.parametrize("name", sorted(CRITERIA_RULES))
def test_criterion_and_negation_split_the_rows(spark, name):
    df = positions(spark, SF)
    for r in CRITERIA_RULES[name]["rules"]:
        kept = where_criteria(df, r["criteria"]).count()
        assert kept + where_criteria(df, {"not": r["criteria"]}).count() == df.count()
