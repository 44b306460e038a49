"""Reference joins: taken names, and versions by each row's own date."""

from __future__ import annotations

import pytest

from foliolens.operators.reference import MOMENT, ReferenceTables, attach_reference, join_as_of, join_instrument


def rows(spark):
    data = [(1, "1995-05-05"), (1, "2003-01-01"), (1, None), (2, "1995-05-05"), (None, "1995-05-05")]
    return spark.createDataFrame(data, f"instrument_id bigint, {MOMENT} string")


def versions(spark):
    data = [(1, "old", "1990-01-01", "2000-01-01"), (1, "new", "2000-01-01", None), (3, "other", "1990-01-01", None)]
    return spark.createDataFrame(data, "instrument_id bigint, name string, valid_from string, valid_to string")


def test_versions_by_row(spark):
    found = join_as_of(rows(spark), versions(spark), ["name"]).collect()
    assert sorted((r["instrument_id"] or 0, r[MOMENT] or "", r["name"] or "") for r in found) == [
        (0, "1995-05-05", ""), (1, "", "new"), (1, "1995-05-05", "old"), (1, "2003-01-01", "new"), (2, "1995-05-05", ""),
    ]


def test_taken_names_are_early_errors(spark):
    named = versions(spark).select("instrument_id", "name")
    once = join_instrument(rows(spark), named)
    with pytest.raises(ValueError, match="name"):
        join_instrument(once, named)
    with pytest.raises(ValueError, match="name"):
        join_as_of(once, versions(spark), ["name"])
    with pytest.raises(ValueError, match="date"):
        attach_reference(rows(spark).drop(MOMENT), None, ReferenceTables(versioned={"v": (versions(spark), ["name"])}))
