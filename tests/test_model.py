"""Settings: rules, modifiers, labels, literals."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from foliolens.functions.criteria import CriteriaCompiler, literal, membership_values, range_bounds, where_criteria
from foliolens.model import Rule, container_labels, custom_rules, resolve_modifiers, stored_rules
from foliolens.operators.factors import rule_chain_sql
from foliolens.model import ViewSet
from foliolens.plans.modifiers import DEFAULT_MODIFIERS, MODIFIERS
from foliolens.registry.inputs import rule, test as crit  # noqa: F401


def test_modifier_order_and_overrides():
    default = DEFAULT_MODIFIERS[0]
    assert resolve_modifiers(None, MODIFIERS, DEFAULT_MODIFIERS) == [default]
    assert resolve_modifiers(["include_all_trade_cash"], MODIFIERS, DEFAULT_MODIFIERS) == ["include_all_trade_cash"]
    assert resolve_modifiers(["exclude_simulated_trades", "include_all_trade_cash", "odd"], MODIFIERS, []) == [
        "exclude_simulated_trades", "odd",
    ]
    assert len(MODIFIERS) == 24


@pytest.mark.parametrize(
    "definitions, message",
    [
        ({"5": {"rules": []}}, "negative"),
        ({"-1": {}}, "rules"),
        ({"-1": {"rules": [{"apply_to": "both"}]}}, "criteria"),
        ({"-1": {"rules": [{"criteria": {}}]}}, "apply_to"),
        ({"-1": {"rules": [{"criteria": {}, "apply_to": "both", "is_scaling_rule": True}]}}, "scale_factor"),
        ({"-1": {"rules": [{"criteria": {}, "apply_to": "Holding"}]}}, "apply_to"),
        ({"-1": {"rules": [{"criteria": {}, "apply_to": "both", "condition_for_next_rule": "xor"}]}}, "and / or"),
    ],
)
def test_custom_rule_errors(definitions, message):
    with pytest.raises(ValueError, match=message):
        custom_rules(definitions)


def test_custom_rules_without_rules_keep_everything():
    assert custom_rules({"0": {"rules": []}, "-1": {"rules": []}}).rules == {}


def test_stored_rules():
    book = stored_rules(
        {
            1: {"rules": [{"criteria": '{"column":"a","required_columns":{"INSTRUMENT":["X","x"]}}', "scale_factor": 50.0,
                           "is_scaling_rule": True, "condition_for_next_rule": "OR"}]},
            2: {"is_active": False, "rules": [{"criteria": {}}]},
            3: {"is_supported": False, "rules": []},
        }
    )
    assert book.rules == {1: [Rule("both", {"column": "a"}, "or", True, 0.5)]}
    assert book.requires == {1: {"instrument": ["x"]}}
    custom = custom_rules({"0": {"rules": [rule({})]}})
    assert set(custom.over(book).rules) == {0, 1}


def test_container_labels_fall_back():
    request = {
        "position_weight_labels": ["W"],
        "lookthrough_weight_labels": ["L"],
        "holding": {"positions": {}, "position_weight_labels": []},
        "reference": {"positions": {}, "position_weight_labels": ["A", "B"]},
        "other": {"rows": {}},
    }
    assert container_labels(request) == {"holding": (["w"], ["l"]), "reference": (["a", "b"], ["l"])}


@pytest.mark.parametrize(
    "sent, items",
    [
        ("( 'north' , \"south\",east )", ["north", "south", "east"]),
        ("[-17,  230,5.5]", [-17, 230, "5.5"]),
        ("'012'", [12]),
        ("north by west, 7", ["north by west", 7]),
        ("", [""]),
        ("1,,2", [1, "", 2]),
        ("('a,b','c')", ["a", "b", "c"]),
        ("A (new), B", ["A (new)", "B"]),
        ("A(1)B,C", ["A(1)B", "C"]),
        (["as", "is"], ["as", "is"]),
        (False, [False]),
        (None, [None]),
    ],
)
def test_listed_items(sent, items):
    assert membership_values(sent) == items


@pytest.mark.parametrize(
    "sent, bounds",
    [
        ("fncriteria:-3:12.75", [-3.0, 12.75]),
        ("fncriteria:2031-01-01:2031-06-30", ["2031-01-01", "2031-06-30"]),
        ([5, 9], [5, 9]),
        ([5, 9, 11], [0, 0]),
        ("five to nine", [0, 0]),
        (None, [0, 0]),
    ],
)
def test_ranges(sent, bounds):
    assert range_bounds(sent) == bounds


def test_range_without_second_bound():
    with pytest.raises(ValueError):
        range_bounds("fncriteria:8")


@pytest.mark.parametrize(
    "pattern, hits",
    [
        ("%ell%", ["Hello", "ell"]),
        ("hel%", ["Hello", "help"]),
        ("%LO", ["Hello"]),
        ("'help'", ["help"]),
        ("h_l%", []),
        ("%", ["Hello", "ell", "help", ""]),
    ],
)
def test_patterns(spark, pattern, hits):
    df = spark.createDataFrame([("Hello",), ("ell",), ("help",), ("",), (None,)], "s string")
    assert [r["s"] for r in where_criteria(df, crit("s", "Like", pattern)).collect()] == hits
    missed = [r["s"] for r in where_criteria(df, crit("s", "NotLike", pattern)).collect()]
    assert len(missed) == 5 - len(hits)


SCHEMA = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("s", T.StringType()), T.StructField("b", T.BooleanType())]
)


@pytest.mark.parametrize(
    "criterion",
    [crit("n", "==", "3"), crit("s", "==", 3), crit("b", "==", 1), crit("n", "In", "(a,b)"), crit("n", "Like", "%1%"),
     crit("missing", "==", 1), crit("n", "Between", ["a", "b"]), crit("n", "==", True)],
)
def test_mismatches_are_early_errors(criterion):
    with pytest.raises(ValueError):
        CriteriaCompiler(SCHEMA).sql(criterion)


@pytest.mark.parametrize("text", ["it's", 'say "x"', "back\\slash", "%_", "ü", "a\nb", "$1", "\\'"])
def test_literals_survive_quoting(spark, text):
    assert spark.sql(f"SELECT {literal(text)} AS x").first()["x"] == text


def test_nested_connector_precedence_and_perspective_substitution(spark):
    df = spark.createDataFrame([(-1,), (-2,), (None,)], "perspective_id bigint")
    criterion = {"and": [crit("perspective_id", "In", "(-2147483648,perspective_id)")], "or": [crit("x", "==", 1)]}
    assert [r[0] for r in where_criteria(df, criterion, -2).collect()] == [-2]


def test_rule_chain_takes_connector_of_raw_predecessor():
    rules = [rule(crit("n", "==", 1), link="and"), rule(crit("n", "==", 2), percent=50, link="or"), rule(crit("n", "==", 3))]
    views = ViewSet.build({"c": {"-1": []}}, {}, custom_rules({"-1": {"rules": rules}}), {}, [])
    assert rule_chain_sql(SCHEMA, views.views[0]) == "((`n` <=> 1L) OR (`n` <=> 3L))"
