"""JSON requests in, JSON responses out; refused requests as error rows."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from foliolens.plans import requests as plan, reuse
from foliolens.plans.requests import process_requests, spec_groups
from foliolens.sources.requests import attribute_types, parse_object_schema, request_sections, section_rows
from foliolens.sources.requests import read_request_stream, with_request_ids
from foliolens.streaming.requests import process_stream

SCHEMA = "request_id string, request string"


def wanted(column="liquid", kind="==", value=True):
    return {"-7": {"rules": [{"apply_to": "both", "criteria": {"column": column, "operator_type": kind, "value": value}}]}}


def ask(**more):
    return {
        "ed": "2031-05-02",
        "perspective_configurations": {"desk": {"-7": []}},
        "custom_perspective_rules": wanted(),
        "position_weight_labels": ["share"],
        "lookthrough_weight_labels": ["share"],
    } | more


def row(instrument, share, liquid=True, **more):
    return {"instrument_id": instrument, "sub_portfolio_id": 44, "share": share, "liquid": liquid} | more


BONDS = {
    "positions": {"bond": row(8001, 0.35), "swap": row(8002, 0.65, False)},
    "essential_lookthroughs": {
        "bond/leg": row(9101, 0.125, parent_instrument_id=8001),
        "swap/leg": row(9102, 0.75, parent_instrument_id=8002),
    },
}
BY_ROW = ask(holding=BONDS)
BY_COLUMN = ask(holding={"positions": {
    "identifier": ["bond", "swap"], "instrument_id": [8001, 8002], "sub_portfolio_id": [44, 44],
    "share": [0.35, 0.65], "liquid": [True, False],
}})


def run(spark, requests, **options):
    rows = [r if isinstance(r, tuple) else (f"r{i}", json.dumps(r)) for i, r in enumerate(requests)]
    return process_requests(spark.createDataFrame(rows, SCHEMA), defaults=[], **options)


def answers(spark, requests, columnar=False, **options):
    documents = {}
    for r in run(spark, requests, **options).documents(columnar).collect():
        documents.setdefault(r["request_id"], []).append(json.loads(r["document"])["perspective_configurations"])
    return documents


def refusals(spark, requests, **options):
    return {r["request_id"]: r["error"] for r in run(spark, requests, **options).errors.collect()}


def kept(request):
    """What the one view of a request leaves, by a plain walk over it."""
    section = request["holding"]
    left = {"positions": {k: v for k, v in section["positions"].items() if v["liquid"]}}
    parents = {v["instrument_id"] for v in left["positions"].values()}
    children = section.get("essential_lookthroughs", {})
    left["essential_lookthroughs"] = {k: v for k, v in children.items() if v["liquid"] and v["parent_instrument_id"] in parents}
    body = {name: {k: {"share": v["share"]} for k, v in rows.items()} for name, rows in left.items() if rows}
    return [{"desk": {"-7": {"holding": body | {"scale_factors": {"share": 1.0}}}}}]


def test_row_and_columnar_requests_together(spark):
    docs = answers(spark, [BY_ROW, BY_COLUMN])
    assert docs["r0"] == kept(BY_ROW)
    assert docs["r1"] == kept(ask(holding={"positions": BONDS["positions"]}))


def test_columnar_answer(spark):
    docs = answers(spark, [BY_COLUMN], columnar=True)
    assert docs["r0"][0]["desk"]["-7"]["holding"]["positions"] == {"identifier": ["bond"], "share": [0.35]}


def test_requests_keep_their_own_views_and_labels(spark):
    second = ask(
        perspective_configurations={"risk": {"-7": ["scale_holdings_to_100_percent"], "-8": []}},
        custom_perspective_rules=wanted("instrument_id", ">=", 31),
        position_weight_labels=["Delta"],
        holding={"positions": {
            "low": {"instrument_id": 30, "sub_portfolio_id": 2, "delta": 0.75},
            "high": {"instrument_id": 31, "sub_portfolio_id": 2, "delta": 0.25},
        }},
    )
    docs = answers(spark, [BY_ROW, second])
    assert docs["r0"] == kept(BY_ROW)
    views = docs["r1"][0]["risk"]
    assert views["-7"]["holding"] == {"positions": {"high": {"delta": 1.0}}, "scale_factors": {"delta": 0.25}}
    assert set(views["-8"]["holding"]["positions"]) == {"low", "high"}


def test_container_without_kept_rows_has_only_scale_factors(spark):
    request = ask(custom_perspective_rules=wanted("instrument_id", ">", 99999), holding=BONDS)
    assert answers(spark, [request])["r0"] == [{"desk": {"-7": {"holding": {"scale_factors": {"share": 1.0}}}}}]


def test_empty_requests(spark):
    docs = answers(spark, [ask(), ask(holding={"positions": {}}), BY_ROW])
    assert docs["r0"] == [{}] and docs["r1"] == [{}] and docs["r2"] == kept(BY_ROW)
    assert answers(spark, [ask(perspective_configurations={}, holding=BONDS)]) == {"r0": [{}]}
    empty = process_requests(spark.createDataFrame([], SCHEMA), defaults=[])
    assert empty.documents().count() == 0 and empty.errors.count() == 0


def test_documents_in_parts(spark):
    many = {f"x{i}": row(500 + i, 0.5, i % 3 > 0) for i in range(240)}
    rows = run(spark, [ask(holding={"positions": many})]).documents(parts=8).collect()
    assert len(rows) == 8
    merged = {}
    for r in rows:
        holding = json.loads(r["document"])["perspective_configurations"]["desk"]["-7"]["holding"]
        assert not merged.keys() & holding.get("positions", {}).keys()
        merged |= holding.get("positions", {})
        assert ("scale_factors" in holding) == (r["part"] == 0)
    assert set(merged) == {k for k, v in many.items() if v["liquid"]}


def test_equal_requests_are_answered_each_and_not_summed(spark):
    scaled = ask(perspective_configurations={"desk": {"-7": ["scale_holdings_to_100_percent"]}}, holding=BONDS)
    text = json.dumps(scaled)
    df = spark.createDataFrame([(text,), (text,), (text,)], "request string")
    found = [json.loads(r["document"]) for r in process_requests(df, defaults=[]).documents().collect()]
    (alone,) = answers(spark, [scaled])["r0"]
    assert [f["perspective_configurations"] for f in found] == [alone] * 3
    assert len(answers(spark, [("same", text), ("same", text)])["same"]) == 2


def test_bad_requests_leave_the_others_alone(spark):
    bad = {
        "text": "{not json", "list": "[1]", "none": "null",
        "container": json.dumps(ask(shelf={"positions": BONDS["positions"]})),
        "section": json.dumps(ask(holding=BONDS | {"odd_lookthroughs": BONDS["essential_lookthroughs"]})),
        "mandatory": json.dumps(ask(holding={"positions": {"p": {"instrument_id": 1, "share": 1.0, "liquid": True}}})),
        "rule": json.dumps(ask(custom_perspective_rules={"-7": {"rules": [{"apply_to": "both"}]}}, holding=BONDS)),
        "column": json.dumps(ask(custom_perspective_rules=wanted("unheard_of"), holding=BONDS)),
        "literal": json.dumps(ask(custom_perspective_rules=wanted("share", "==", "much"), holding=BONDS)),
    }
    batch = [("good", json.dumps(BY_ROW)), *bad.items(), ("twice", json.dumps(BY_ROW)), ("twice", json.dumps(BY_COLUMN)), ("well", json.dumps(BY_COLUMN))]
    done = run(spark, batch)
    docs = {r["request_id"]: json.loads(r["document"])["perspective_configurations"] for r in done.documents().collect()}
    assert docs == {"good": kept(BY_ROW)[0], "well": kept(ask(holding={"positions": BONDS["positions"]}))[0]}
    errors = {r["request_id"]: r["error"] for r in done.errors.collect()}
    assert set(errors) == {*bad, "twice"}
    for name, part in {
        "text": "JSON", "list": "JSON", "none": "JSON", "container": "unknown container: shelf", "section": "unknown record_type: odd_lookthroughs",
        "mandatory": "sub_portfolio_id", "rule": "criteria", "column": "unheard_of", "literal": "much", "twice": "this id",
    }.items():
        assert part in errors[name], name


def test_more_specifications_than_one_plan_has(spark, monkeypatch):
    monkeypatch.setattr(plan, "SPECS", 3)
    requests = [ask(custom_perspective_rules=wanted("instrument_id", ">", 8000 + i % 2), ed=str(i), position_weight_labels=["share", f"l{i}"], holding=BONDS) for i in range(8)]
    docs = answers(spark, requests)
    for i in range(8):
        assert set(docs[f"r{i}"][0]["desk"]["-7"]["holding"]["positions"]) == ({"swap"} if i % 2 else {"bond", "swap"})


def test_injected_names_win_and_types_are_inferred(spark):
    odd = row(7, 2, identifier="mine", container="elsewhere") | {"it's 1 col": 0.5}
    df = with_request_ids(spark.createDataFrame([(json.dumps(ask(holding={"positions": {"p": odd}})),)], "request string"))
    assert df.first()["request_id"]
    types = attribute_types(section_rows(request_sections(df)))
    assert (types["share"], types["it's 1 col"], types["liquid"]) == ("bigint", "double", "boolean")
    docs = answers(spark, [ask(holding={"positions": {"p": odd}})])
    assert docs["r0"][0]["desk"]["-7"]["holding"]["positions"] == {"p": {"share": 2.0}}


def test_object_schema():
    assert parse_object_schema("OBJECT<n: BIGINT, `x y`: DECIMAL(9,4), l: ARRAY<STRING>, o: OBJECT<i: DOUBLE>>") == {
        "n": "bigint", "x y": "double", "l": "string", "o": "string",
    }


@pytest.mark.parametrize("groups", [1, 4])
def test_spec_groups_are_whole(spark, groups):
    rows = [(f"r{i}", json.dumps(ask(custom_perspective_rules=wanted("instrument_id", "<", i), holding=BONDS))) for i in range(9)]
    parts = [[r["request_id"] for r in g.collect()] for g in spec_groups(spark.createDataFrame(rows, SCHEMA), groups)]
    assert sorted(x for p in parts for x in p) == sorted(i for i, _ in rows)


def stored_files(spark) -> list[str]:
    """What lies in the folders that stored frames may use."""
    folder = Path(reuse.shared_folder(spark).removeprefix("file:"))
    return sorted(str(p) for p in folder.rglob("*.parquet"))


def test_a_stream_keeps_no_stored_frames(spark, tmp_path):
    """Every batch deletes its own frames, also one that fails; others' frames stay."""
    own = reuse.materialize(spark.range(3))
    before = stored_files(spark)
    (tmp_path / "in").mkdir()
    for i in range(3):
        text = json.dumps(ask(request_id=f"r{i}", holding=BONDS))
        (tmp_path / "in" / f"{i}.txt").write_text(text + "\nbroken\n")
    stream = read_request_stream(spark, str(tmp_path / "in"), max_files=1)
    during = []
    batches = process_stream(
        stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True, defaults=[],
        on_batch=lambda batch, number: during.append(stored_files(spark)),
    )
    batches.awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(during) == 3 and sum(r["document"] is not None for r in done) == 3 and sum(r["error"] is not None for r in done) >= 1
    assert all(d == before for d in during) and stored_files(spark) == before and before
    with pytest.raises(ZeroDivisionError), reuse.own_frames(spark):
        reuse.materialize(spark.range(5))
        assert len(stored_files(spark)) > len(before)
        1 / 0
    assert stored_files(spark) == before and own.count() == 3
