"""Requests that differ in the numbers of their criteria alone share their views."""

from __future__ import annotations

import json

from foliolens.plans import requests as plan
from foliolens.plans.requests import process_requests

SCHEMA = "request_id string, request string"
POSITIONS = {f"p{i}": {"instrument_id": 100 + i, "sub_portfolio_id": 3, "note": 'a "value":7, b' if i == 2 else "c", "share": i / 4} for i in range(6)}


def criterion(column, kind, value):
    return {"column": column, "operator_type": kind, "value": value}


def ask(*criteria, scaling=None):
    rules = [{"apply_to": "both", "criteria": c} for c in criteria]
    if scaling:
        rules.append({"apply_to": "both", "criteria": scaling, "is_scaling_rule": True, "scale_factor": 50})
    return {
        "perspective_configurations": {"desk": {"-7": []}},
        "custom_perspective_rules": {"-7": {"rules": rules}},
        "position_weight_labels": ["share"],
        "holding": {"positions": POSITIONS},
    }


def run(spark, requests):
    return process_requests(spark.createDataFrame([(k, json.dumps(v)) for k, v in requests.items()], SCHEMA), defaults=[])


def factors(done):
    found = {}
    for r in done.result.positions.collect():
        found.setdefault(r["request_id"], {})[r["identifier"]] = r["factor"]
    return found


def test_own_numbers_one_plan(spark, monkeypatch):
    monkeypatch.setattr(plan, "SPECS", 2)
    requests = {
        f"r{i}": ask(criterion("instrument_id", ">", 99 + i), criterion("share", "<=", 1.25 - i / 8), scaling=criterion("instrument_id", "==", 102 + i % 3))
        for i in range(6)
    }
    done = run(spark, requests)
    assert len(done.blocks) == 1 and len(done.blocks[0][1].views.views) == 1
    wanted = {
        f"r{i}": {f"p{n}": 0.5 if n == 2 + i % 3 else 1.0 for n in range(6) if n > i - 1 and n / 4 <= 1.25 - i / 8} for i in range(6)
    }
    assert factors(done) == {k: v for k, v in wanted.items() if v}


def test_shapes_of_several_kinds(spark):
    requests = {
        "in": ask(criterion("instrument_id", "In", 103)),
        "list": ask(criterion("instrument_id", "In", [101, 103])),
        "range": ask(criterion("share", "Between", [0.25, 0.75])),
        "nested": ask({"or": [criterion("instrument_id", "<", 101), {"not": criterion("share", "<", 1.25)}]}),
        "other": ask({"or": [criterion("instrument_id", "<", 102), {"not": criterion("share", "<", 1e9)}]}),
        "text": ask(criterion("note", "Like", '%"value":7, b')),
        "long": ask(criterion("instrument_id", "<", 10**30)),
        "two": ask(criterion("instrument_id", ">=", 101), criterion("instrument_id", "<=", 102), criterion("share", "!=", 0.5)),
    }
    kept = {k: set(v) for k, v in factors(run(spark, requests)).items()}
    assert kept == {
        "in": {"p3"}, "list": {"p1", "p3"}, "range": {"p1", "p2", "p3"}, "nested": {"p0", "p5"}, "other": {"p0", "p1"},
        "text": {"p2"}, "long": set(POSITIONS), "two": {"p1"},
    }


def test_errors_name_the_own_number(spark):
    requests = {"a": ask(criterion("note", "==", 41)), "b": ask(criterion("note", "==", 42)), "c": ask(criterion("share", ">", 1), criterion("note", "==", 0.5)), "good": ask()}
    done = run(spark, requests)
    errors = {r["request_id"]: r["error"] for r in done.errors.collect()}
    assert set(errors) == {"a", "b", "c"}
    assert errors["a"].startswith("41 cannot") and errors["b"].startswith("42 cannot") and errors["c"].startswith("0.5 cannot")
    assert set(factors(done)) == {"good"}
