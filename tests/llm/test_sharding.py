from __future__ import annotations

import itertools
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliolens.llm.common import table
from foliolens.llm.sharding import _string_edges, hilbert_index, shard_rows, sharded
from tests.llm.rows import no_documents, odd_documents, odd_rows


@pytest.mark.parametrize("axes,bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_curve_visits_every_point_by_single_steps(spark, axes, bits):
    points = list(itertools.product(range(1 << bits), repeat=axes))
    names = [f"c{i}" for i in range(axes)]
    df = spark.createDataFrame(points, ", ".join(f"{n} int" for n in names))
    found = df.select(*names, hilbert_index([F.col(n) for n in names], bits).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in found] == list(range(len(points)))
    for a, b in itertools.pairwise(found):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_laws_slots_and_copies(spark, law):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = shard_rows(docs, law=law).collect()
    assert len(found) == docs.count()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        even, most = sum(sizes.values()) / 16, max(r["size"] for r in found)
        assert all(abs(s - even) <= 0.1 * even + most for s in sizes.values())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in found:
        data = texts[r["k"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    ranked = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in ranked] == sorted(r["curve"] for r in found)
    by_text = defaultdict(set)
    for r in found:
        by_text[texts[r["k"]]].add(r["shard"])
    if law == "bytes":
        assert all(len(s) == 1 for s in by_text.values())


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = shard_rows(docs).collect()
    assert len(found) == len(odd_rows())
    out = sharded(docs)
    assert out.columns == [*docs.columns, "_shard", "_curve"] and out.count() == len(odd_rows())
    assert shard_rows(no_documents(spark)).count() == 0 and sharded(no_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        shard_rows(docs, law="other")


def test_group_too_large_for_a_shard_is_parted(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}", "en", "a", 9) for i in range(400)]
    found = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 25


def test_strings_of_one_beginning_are_told_apart(spark):
    rows = [(i, f"text {i}", "en", f"https://site{i % 8}.example", 9) for i in range(800)]
    found = shard_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    by_curve = defaultdict(set)
    for r in found:
        by_curve[r["curve"]].add(r["k"] % 8)
    assert len(by_curve) == 8 and all(len(s) == 1 for s in by_curve.values())


def test_string_edges_are_quantiles(spark):
    values = [w for w, n in {"a": 5, "ab": 40, "b": 3, "é": 12, "z" * 50: 40}.items() for _ in range(n)]
    df = spark.createDataFrame([(v, None if v == "b" else v) for v in values], "x string, y string")
    cuts = [0.25, 0.5, 0.75]
    found = _string_edges(df, ["x", "y"], cuts)
    for name, own in (("x", values), ("y", [v for v in values if v != "b"])):
        own = sorted(own, key=str.encode)
        assert sorted(found[name], key=str.encode) == sorted({own[math.ceil(c * len(own)) - 1] for c in cuts}, key=str.encode)
