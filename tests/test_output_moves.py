"""Output rows move once, to the section that they are gathered in."""

from __future__ import annotations

import pytest

from foliolens.model import ViewSet
from foliolens.operators.output import flat_result, nested_result
from foliolens.plans.pipeline import process_tables

SCHEMA = "container string, record_type string, identifier string, instrument_id bigint, sub_portfolio_id bigint, gross double, net double"
ROWS = [
    ("holding", "positions", "a", 1, 5, 0.25, 1.0), ("holding", "positions", "a", 2, 5, 0.5, None), ("holding", "positions", "b", 1, 5, None, 3.0),
    ("selected_reference", "positions", "a", 9, 5, 0.125, 4.0), ("selected_reference", "positions", "a", 9, 5, 0.125, 5.0),
]


def result(spark):
    labels = {"holding": (["net", "gross"], []), "selected_reference": (["net"], [])}
    views = ViewSet.build({"one": {"-1": []}}, labels, defaults=[])
    return process_tables(spark.createDataFrame(ROWS, SCHEMA), None, views)


@pytest.mark.parametrize("shape", [nested_result, flat_result])
def test_one_shuffle(spark, shape):
    plan = shape(result(spark), 3)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1, final


def test_labels_and_the_largest_row(spark):
    found = {(r["container"], k): v for r in nested_result(result(spark), 2).collect() for k, v in r["rows"].items()}
    assert found == {
        ("holding", "a"): {"net": None, "gross": 0.5}, ("holding", "b"): {"net": 3.0, "gross": None}, ("selected_reference", "a"): {"net": 5.0},
    }
    assert list(found["holding", "a"]) == ["net", "gross"]
