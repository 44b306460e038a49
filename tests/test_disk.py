"""What queries leave on disk on their way: shuffles that go early, texts that aren't stored, rows that move once."""

from __future__ import annotations

import re
import time
from pathlib import Path

import pytest

from foliolens.plans.requests import process_requests
from foliolens.plans.reuse import materialize, own_frames, settings, shared_folder
from foliolens.registry.audit_queries import QUERIES as AUDITS
from foliolens.registry.source_queries import TYPES, json_requests
from foliolens.sources.requests import READING, attribute_types, request_sections, section_rows

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string"
)


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of four requests; the one with an order twice is refused, as is the one without an id."""
    orders = [(k, k % 7, "FOP"[k % 3], 100.25 + k, f"{k % 5 + 1}-X") for k in (0, 1, 2, 49, 50, 51, 100, 100)] + [(None, 1, "F", 1.0, "1-X")]
    lines = [(k, p, p + 1, p, 8.0, 10.5, "NAR"[p % 3]) for k in (0, 1, 49, 50, 100, 100, 999) for p in (1, 2)] + [(None, 1, 1, 1, 1.0, 1.0, "N")]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def exchanges(df) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def shuffle_blocks(spark, wanted: int) -> int:
    """Shuffle files of the session, after the time that deleting them may take."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        found = blocks.getAllBlocks().mkString(" ").count("shuffle_")
        if found <= wanted:
            break
        time.sleep(0.1)
    return found


def test_shuffles_go_when_their_rows_are_stored(spark):
    before = shuffle_blocks(spark, 0)
    stored = materialize(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count())
    assert shuffle_blocks(spark, before) <= before
    assert stored.count() == 10


def test_shuffles_go_when_types_are_found(spark, folder):
    requests = json_requests(spark, folder)
    before = shuffle_blocks(spark, 0)
    types = attribute_types(section_rows(request_sections(requests)))
    assert types["instrument_id"] == "bigint" and shuffle_blocks(spark, before) <= before


def test_rows_of_requests_move_once(spark, folder):
    with settings(spark, READING | {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        requests = json_requests(spark, folder)
        found = exchanges(requests)
        assert len(found) == 3 and all(re.fullmatch(r"_block#\d+, \d+", e) for e in found), found
        texts = {r["request_id"]: r["request"] for r in requests.collect()}
    assert sorted(texts, key=str) == [None, "r0", "r1", "r2"]
    assert texts["r0"].count('"parent_instrument_id":') == 6 and texts["r2"].count('"parent_instrument_id":') == 2


def test_texts_are_not_stored(spark, folder):
    with own_frames(spark):
        before = set(Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))
        run = process_requests(json_requests(spark, folder).where("request_id IS NOT NULL"), types=TYPES, defaults=[])
        new = set(Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")) - before
        columns = {c for p in new if p.is_file() for c in spark.read.parquet(str(p)).columns}
        assert "spec" in columns and not columns & {"request", "_parsed"}
        assert run.documents().count() == 2 and run.requests.where("request IS NOT NULL").count() == 3


def test_sections_and_documents_do_not_move(spark, folder):
    with own_frames(spark), settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        found = exchanges(process_requests(json_requests(spark, folder), types=TYPES, defaults=[]).documents())
        assert found and not any("part#" in e or "section" in e for e in found), found


def test_streamed_requests_are_compressed(spark, folder):
    with own_frames(spark):
        before = set(Path(shared_folder(spark).removeprefix("file:")).rglob("in/part-*"))
        rows = AUDITS["S-10_read_request_stream"][0](spark, folder)
        texts = set(Path(shared_folder(spark).removeprefix("file:")).rglob("in/part-*")) - before
        assert texts and all(p.name.endswith(".gz") for p in texts)
        assert {r["request_id"] for r in rows.collect()} == {"r0", "r1"}
