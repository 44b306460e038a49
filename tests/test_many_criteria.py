"""Many views that compare a column with numbers of their own: looked up, not tested one by one."""

from __future__ import annotations

import operator

import pytest

from foliolens.model import Rule, ViewSet, RuleBook
from foliolens.operators.factors import Planes, factors, mask_words

SCHEMA = (
    "request_id string, container string, record_type string, identifier string, instrument_id bigint, "
    "parent_instrument_id bigint, sub_portfolio_id bigint, grade int, yield double"
)
GRADES = [None, -3, 0, 1, 7, 31, 32, 33, 64, 140, 141, 500]
YIELDS = [None, float("nan"), -1.0, -0.0, 0.0, 0.5, 7.25, 8.0, 32.0, 70.5, 71.0, 1e9]
ROWS = [("all", "holding", "positions", f"i{n}", n, n, 1, g, y) for n, (g, y) in enumerate(zip(GRADES, YIELDS, strict=True))]
KINDS = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def holds(kind, given, number):
    """The criterion by its definition: missing values are equal to nothing and below everything, NaN is above everything."""
    if given is None:
        return kind in ("!=", "<", "<=")
    return KINDS[kind](float("inf") if given != given else given, number)


def views(column, kind, numbers, scope="both"):
    rules = {-n - 1: [Rule(scope, {"column": column, "operator_type": kind, "value": v})] for n, v in enumerate(numbers)}
    return ViewSet.build({"many": {pid: [] for pid in rules}}, {}, RuleBook(rules), defaults=[])


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize(("column", "given", "numbers"), [
    ("grade", GRADES, [*range(-2, 142), 32, 7]),
    ("yield", YIELDS, [n / 2 for n in range(-2, 142)] + [0, 8, 71]),
])
def test_every_view_keeps_its_rows(spark, kind, column, given, numbers):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    found = factors(rows, views(column, kind, numbers)).select("perspective_id", "identifier").collect()
    wanted = [(-n - 1, f"i{i}") for n, v in enumerate(numbers) for i, g in enumerate(given) if holds(kind, g, v)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_numbers_of_several_steps(spark):
    """Rules joined by and / or, beside criteria of few numbers."""
    rules = {
        -n: [
            Rule("both", {"column": "grade", "operator_type": "<=", "value": n % 3}, "or"),
            Rule("both", {"column": "yield", "operator_type": ">", "value": n}, "and"),
            Rule("holding", {"column": "grade", "operator_type": "!=", "value": n}),
        ]
        for n in range(1, 131)
    }
    vs = ViewSet.build({"many": {pid: [] for pid in rules}}, {}, RuleBook(rules), defaults=[])
    found = factors(spark.createDataFrame(ROWS, SCHEMA), vs).select("perspective_id", "identifier").collect()
    wanted = [
        (-n, f"i{i}") for n in range(1, 131) for i, (g, y) in enumerate(zip(GRADES, YIELDS, strict=True))
        if (holds("<=", g, n % 3) or holds(">", y, n)) and holds("!=", g, n)
    ]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_the_plan_does_not_grow_with_the_numbers(spark):
    schema = spark.createDataFrame([], SCHEMA).schema
    planes = Planes()
    masks = mask_words(schema, list(views("grade", ">", range(1000)).views), planes)
    assert not planes.number
    assert sum(sql.count("if(") for sql in masks.values()) <= len(masks)


def test_few_numbers_are_tested_one_by_one(spark):
    planes = Planes()
    mask_words(spark.createDataFrame([], SCHEMA).schema, list(views("grade", ">", range(5)).views), planes)
    assert len(planes.number) == 5
