"""Samples put few rows in order."""

from __future__ import annotations

import random

import pytest

from foliolens.operators import audit


@pytest.mark.parametrize("weights", [lambda i: float(i % 1000), lambda i: 1.0, lambda i: None, lambda i: [None, float("nan"), 1.0][i % 3]])
def test_samples_are_the_heaviest_rows(spark, monkeypatch, weights):
    """Whatever ties, missing weights and repeated rows there are; few rows meet the rank limit."""
    rng = random.Random(2)
    rows = [("r", "c", -1, "step", "holding", "positions", f"x{i % 700}", i % 700, weights(i)) for i in range(2000)]
    rows += [("r", "c", -1, "step", "other", "positions", "same", 7, weights(i)) for i in range(2)]
    rows += [("r", "c", -1, "output", "holding", "positions", "kept", 1, 1e9)]
    rng.shuffle(rows)
    schema = "request_id string, config string, perspective_id bigint, step string, container string, record_type string, identifier string, instrument_id bigint, w double"
    met, join = [], audit.join_groups

    def spied(left, groups, keys):
        met.append((left, groups))
        return join(left, groups, keys)

    monkeypatch.setattr(audit, "join_groups", spied)
    found = audit.removed_samples(spark.createDataFrame(rows, schema), 3, "w").collect()
    heavier = lambda w: (w is not None, w is not None and w != w, w if w is not None and w == w else 0.0)
    want = []
    for container in ("holding", "other"):
        own = sorted((r for r in rows if r[3] == "step" and r[4] == container), key=lambda r: (r[6], r[7]))
        own = sorted(own, key=lambda r: heavier(r[8]), reverse=True)
        want += [(container, n, r[6], str(r[8]), max(len(own) - 3, 0)) for n, r in enumerate(own[:3], 1)]
    assert sorted((r["container"], r["rank"], r["identifier"], str(r["w"]), r["more"]) for r in found) == want
    left, groups = met[0]
    if weights(5) == 5.0:
        assert left.join(groups, audit.STEP_KEYS).where("w >= _least AND container = 'holding'").count() < 50
