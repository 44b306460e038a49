"""Shares of view totals: rows are not shuffled by the few views they belong to."""

from __future__ import annotations

import pytest

from foliolens.operators.metrics import METRICS, normalize_columns
from tests.conftest import table

SCHEMA = "request_id string, config string, perspective_id long, " + ", ".join(f"{m} double" for m in METRICS)


def test_rows_of_one_view_stay_where_they_are(spark):
    rows = [
        {"request_id": "all", "config": "main", "perspective_id": -1 - i % 2, "PI": float(i), "PR": 0.0, "BS": None, "BC": 2.0}
        for i in range(10)
    ]
    shares = normalize_columns(table(spark, rows, SCHEMA))
    text = shares._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    found = sorted((r["perspective_id"], r["PI"], r["PR"], r["BS"], r["BC"]) for r in shares.select("perspective_id", "PI", "PR", "BS", "BC").collect())
    totals = {-1: 20.0, -2: 25.0}
    expected = sorted((r["perspective_id"], r["PI"] / totals[r["perspective_id"]]) for r in rows)
    assert [f[0] for f in found] == [e[0] for e in expected]
    assert [f[1] for f in found] == pytest.approx([e[1] for e in expected])
    assert {f[2:4] for f in found} == {(0.0, None)} and [f[4] for f in found] == pytest.approx([0.2] * 10)
