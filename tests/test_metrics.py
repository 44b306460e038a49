"""Downstream metrics and requirements with known results."""

from __future__ import annotations

import json

import pytest

from foliolens import Modifier, ViewSet, custom_rules, process_tables
from foliolens.operators.audit import attributed_rows, waterfall
from foliolens.operators.catalog import criteria_leaves, nested_criteria_report, required_columns, rule_columns
from foliolens.operators.metrics import all_levels, drop_zero_weight_rows, portfolio_metrics
from foliolens.operators.normalize import lowercase_columns, normalize
from foliolens.registry.inputs import rule, test as crit
from foliolens.sources.rules import read_perspectives, rule_book
from tests.conftest import table

LABELS = ["initial_weight", "resulting_weight", "initial_exposure_weight", "resulting_exposure_weight"]
POSITION = "container string, identifier string, instrument_id bigint, sub_portfolio_id bigint, weight double, " + ", ".join(
    f"{w} double" for w in LABELS
)
CHILD = "container string, record_type string, identifier string, instrument_id bigint, parent_instrument_id bigint, sub_portfolio_id bigint, weight double"


def position(identifier, instrument, container="holding", **weights):
    return {"container": container, "identifier": identifier, "instrument_id": instrument, "sub_portfolio_id": 10} | weights


def run(spark, positions, children=None, rules=None, configs=None):
    views = ViewSet.build(
        configs or {"cfg": {"-1": []}},
        {"holding": (LABELS, []), "selected_reference": (["weight"], []), "contractual_reference": (["weight"], [])},
        custom_rules(rules or {"-1": {"rules": [rule({})]}}),
        defaults=[],
    )
    lookthroughs = table(spark, children, CHILD) if children else None
    return process_tables(table(spark, positions, POSITION), lookthroughs, views)


def metrics(result, level):
    rows = portfolio_metrics(result.positions, result.lookthroughs, level).collect()
    return {(r["perspective_id"], r["instrument_id"], r["parent_instrument_id"]): r for r in rows}


def test_level_no_uses_raw_weights(spark):
    shares = {"initial_weight": 0.3125, "resulting_weight": 0.4375, "initial_exposure_weight": 0.125, "resulting_exposure_weight": 0.0625}
    selected, contractual, assets = 0.21875, 0.140625, 1_000_000
    r = metrics(run(spark, [
        position("own", 77, **shares), position("sel", 77, "selected_reference", weight=selected),
        position("con", 77, "contractual_reference", weight=contractual),
    ]), "no")[(-1, 77, 77)]
    model = {
        "PI": shares["initial_weight"], "PR": shares["resulting_weight"],
        "AIS": shares["initial_weight"] - selected, "AIC": shares["initial_weight"] - contractual,
    }
    for name, value in model.items():
        assert r[name] == pytest.approx(value)
        if name + "V" in r.asDict():
            assert r[name + "V"] == pytest.approx(value * assets)


def test_child_and_leaf(spark):
    """A child has its part of the parent's exposure; without children the parent is its own leaf."""
    exposures, part = {"initial": 0.84, "resulting": 0.36}, 0.25
    weights = {f"{k}_exposure_weight": v for k, v in exposures.items()}
    fund = position("fund", 612, initial_weight=0.9, resulting_weight=0.9, **weights)
    share = {"container": "holding", "record_type": "essential_lookthroughs", "identifier": "share", "instrument_id": 55,
             "parent_instrument_id": 612, "sub_portfolio_id": 10, "weight": part}
    result = run(spark, [fund], [share])
    essential, complete = metrics(result, "essential"), metrics(result, "complete")
    assert list(essential) == [(-1, 55, 612)] and list(complete) == [(-1, 612, 612)]
    for found, factor in ((essential[(-1, 55, 612)], part), (complete[(-1, 612, 612)], 1)):
        assert (found["PI"], found["PR"]) == pytest.approx((exposures["initial"] * factor, exposures["resulting"] * factor))
    assert {r["level"] for r in all_levels(result.positions, result.lookthroughs).select("level").collect()} == {"no", "essential", "complete"}


def test_duplicates_and_tiny_weights(spark):
    result = run(spark, [
        position("a", 1, initial_weight=0.3, resulting_weight=0.25), position("b", 1, initial_weight=0.2, resulting_weight=0.15),
        position("c", 2, initial_weight=1e-16, resulting_weight=0.5),
    ])
    r = metrics(result, "no")
    assert (r[(-1, 1, 1)]["PI"], r[(-1, 1, 1)]["PR"]) == pytest.approx((0.5, 0.4))
    assert (r[(-1, 2, 2)]["PI"], r[(-1, 2, 2)]["PR"]) == (0.0, 0.5)


def test_drop_zero_weight_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, None)], "id int, a double, b double")
    assert [r["id"] for r in drop_zero_weight_rows(df, ["a", "b"]).orderBy("id").collect()] == [2, 3]


DOCUMENTS = [
    (1, '{"id":1,"rules":[{"criteria":"{\\"column\\":\\"x\\",\\"required_columns\\":{\\"INSTRUMENT\\":[\\"col1\\",\\"COL2\\"]}}"}]}'),
    (2, '{"id":1,"rules":[{"criteria":{"and":[{"not":{"column":"a","operator_type":"In","value":{"table_name":"T"}}},'
        '{"column":"b","operator_type":"In","value":{"table_name":"Rule_Result"}}],'
        '"required_columns":{"instrument":["col1","col4"],"Instrument_Categorization":["COL5"],"InstrumentInput":["W"]}},'
        '"apply_to":"holding","condition_for_next_rule":"or","is_scaling_rule":true,"scale_factor":70}]}'),
    (3, '{"id":2,"is_active":true,"rules":[{"criteria":{"required_columns":{"PARENT_INSTRUMENT":["instrument_id","parent_name"],'
        '"ASSET_ALLOCATION_ANALYTICS_CATEGORY_V":["analytics_category_id"]}}}]}'),
    (4, '{"id":3,"is_active":true,"rules":[{"criteria":{"required_columns":{"gone":["x"]}}}]}'),
    (5, '{"id":3,"is_active":false}'),
]


def needs(spark, requests, defaults=()):
    rules = rule_columns(read_perspectives(spark.createDataFrame(DOCUMENTS, "ordinal int, document string")))
    df = spark.createDataFrame(requests, "request_id string, config string, perspective_id bigint, modifier string")
    modifiers = {"m": Modifier("m", "PreProcessing", {}, requires={"POSITION_DATA": ["Liquidity_type_id"], "INSTRUMENT": ["name"]})}
    found: dict = {}
    for r in required_columns(df, rules, modifiers, list(defaults)).collect():
        found.setdefault(r["request_id"], {}).setdefault(r["table"], set()).add(r["column"])
    return found


def test_requirements(spark):
    found = needs(spark, [("r1", "c", 1, None), ("r2", "c", 2, None), ("r3", "c", 3, None), ("r4", "c", 9, "m"), ("r5", "c", 9, "odd")])
    assert found == {
        "r1": {"instrument": {"col1", "col2", "col4"}, "instrument_categorization": {"col5"}, "position_data": {"w", "sub_portfolio_id"}},
        "r2": {"position_data": {"asset_allocation_id", "parent_instrument_id", "sub_portfolio_id"}, "parent_instrument": {"parent_name"}},
        "r3": {"position_data": {"sub_portfolio_id"}},
        "r4": {"position_data": {"liquidity_type_id", "sub_portfolio_id"}, "instrument": {"name"}},
        "r5": {"position_data": {"sub_portfolio_id"}},
    }


def test_stored_perspectives(spark):
    rules = read_perspectives(spark.createDataFrame(DOCUMENTS, "ordinal int, document string"))
    book = rule_book(rules, [1, 3])
    assert set(book.rules) == {1}
    first, second = book.rules[1]
    assert first.criteria == {"column": "x"} and second.apply_to == "holding"
    assert (second.link, second.is_scaling, second.scale_factor) == ("or", True, 0.7)
    report = nested_criteria_report(rules).collect()
    assert [(r["perspective_id"], r["path"], r["outer_column"]) for r in report] == [(1, "and.0.not.0", "a")]
    leaves = criteria_leaves(rules.where("perspective_id = 1"), ["ordinal"]).collect()
    assert sorted(r["column"] for r in leaves) == ["a", "b", "x"]


def test_deep_and_odd_criteria_unfold(spark):
    """Whatever the depth, without an action; what is no connector is a leaf."""
    deep, places = {"column": "d"}, []
    for level in range(140):
        deep = [{"not": deep}, {"and": [{"column": f"s{level}"}, deep]}][level % 2]
        places.insert(0, ["not.0", "and.1"][level % 2])
    texts = [(1, json.dumps(deep)), (2, '{"and": []}'), (3, "{}"), (4, None), (5, '{"or": [null, {"column": "and"}]}'), (6, "no json")]
    rules = spark.createDataFrame(texts, "k int, criteria string")
    found = criteria_leaves(rules, ["k"]).collect()
    assert {(r["path"], r["column"]) for r in found if r["k"] == 1 and r["column"] == "d"} == {(".".join(places), "d")}
    assert sum(r["k"] == 1 for r in found) == 71
    rest = sorted((r["k"], r["path"], r["column"] or "") for r in found if r["k"] > 1)
    assert rest == [(3, "", ""), (5, "or.0", ""), (5, "or.1", "and"), (6, "", "")]


def test_waterfall_adds_up(spark):
    views = ViewSet.build(
        {"c": {"-1": ["pre"]}}, {"holding": (["initial_weight"], [])},
        custom_rules({"-1": {"rules": [rule(crit("instrument_id", ">", 2)), rule(crit("instrument_id", "<", 5))]}}),
        {"pre": Modifier("pre", "PreProcessing", crit("instrument_id", "==", 6))}, [],
    )
    data = normalize(table(spark, [position(str(i), i, initial_weight=1.0) for i in range(1, 8)], POSITION), ["initial_weight"], "positions")
    rows = waterfall(attributed_rows(data, None, views, ["initial_weight"]), ["initial_weight"]).collect()
    assert {r["step"]: (r["rows"], r["initial_weight"]) for r in rows} == {
        "pre": (1, 1.0), "rule_0": (2, 2.0), "rule_1": (2, 2.0), "output": (2, 2.0),
    }


def test_normalisation_errors(spark):
    with pytest.raises(ValueError, match="case"):
        lowercase_columns(spark.createDataFrame([(1, 2)], "a int, A int"))
    bad = table(spark, [position("h", 1, "holdings", initial_weight=1.0)], POSITION)
    with pytest.raises(Exception, match="unknown container"):
        normalize(bad, [], "positions").collect()


def test_names_are_lowercased_and_instrument_identifier_wins(spark):
    df = spark.createDataFrame([("holding", "a", 5, 7, 1)], "Container string, IDENTIFIER string, Instrument_Id int, instrument_identifier int, SUB_PORTFOLIO_ID int")
    row = normalize(df, [], "positions").first()
    assert (row["instrument_id"], row["instrument_identifier"], row["record_type"], row["request_id"]) == (7, 7, "positions", "all")
