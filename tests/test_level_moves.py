"""What the metrics of all levels leave on disk: rows that move once, and go when their sums are stored."""

from __future__ import annotations

from pathlib import Path

from foliolens.operators.metrics import all_levels, grouped_levels
from foliolens.plans.reuse import DEALT, own_frames, settings, shared_folder
from tests.conftest import table
from tests.test_disk import exchanges

POSITIONS = (
    "request_id string, config string, perspective_id bigint, container string, instrument_id bigint, sub_portfolio_id bigint, "
    "out_initial_weight double, out_initial_exposure_weight double, out_weight double"
)
CHILDREN = (
    "request_id string, config string, perspective_id bigint, container string, record_type string, instrument_id bigint, "
    "parent_instrument_id bigint, sub_portfolio_id bigint, weight double"
)


def frames(spark):
    base = {"request_id": "all", "config": "main", "perspective_id": -1, "sub_portfolio_id": 5}
    pos = [
        base | {"container": c, "instrument_id": i, "out_initial_weight": w, "out_initial_exposure_weight": w and w / 2, "out_weight": b}
        for c, i, w, b in (("holding", 1, 0.25, None), ("holding", 1, 0.5, None), ("holding", 2, 0.25, None), ("selected_reference", 1, None, 2.0))
    ]
    kids = [
        base | {"container": "holding", "record_type": f"{t}_lookthroughs", "instrument_id": i, "parent_instrument_id": 1, "weight": w}
        for t, i, w in (("essential", 7, 0.5), ("essential", 7, 0.25), ("complete", 8, 1.0))
    ]
    return table(spark, pos, POSITIONS), table(spark, kids, CHILDREN)


def test_rows_of_all_levels_move_once(spark):
    pos, lt = frames(spark)
    keys = ["request_id", "config", "perspective_id"]
    with settings(spark, DEALT | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        dealt = pos.repartition(*keys, "instrument_id", "sub_portfolio_id"), lt.repartition(*keys, "parent_instrument_id", "sub_portfolio_id")
        rows = grouped_levels(*dealt, ["no", "essential", "complete"])
        assert len(exchanges(rows)) == 2, exchanges(rows)
        found = {(r["level"], r["instrument_id"], r["parent_instrument_id"]): (r["PI"], r["BS"]) for r in rows.collect()}
    assert found == {
        ("no", 1, 1): (0.75, 2.0), ("no", 2, 2): (0.25, 0.0),
        ("essential", 7, 1): (0.28125, 0.0), ("essential", 1, 1): (0.0, 2.0), ("essential", 2, 2): (0.125, 0.0),
        ("complete", 8, 1): (0.375, 0.0), ("complete", 1, 1): (0.0, 2.0), ("complete", 2, 2): (0.125, 0.0),
    }


def test_kept_rows_go_when_their_sums_are_stored(spark):
    with own_frames(spark):
        before = set(Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))
        rows = all_levels(*frames(spark), scale_holdings=True)
        new = set(Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")) - before
        columns = {c for p in new if p.is_file() for c in spark.read.parquet(str(p)).columns}
        assert "PI" in columns and not columns & {"out_initial_weight", "record_type"}
        assert rows.count() == 8
