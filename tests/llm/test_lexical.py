from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliolens.llm import lexical
from foliolens.llm.queries import QUERIES
from tests.llm.rows import no_documents, odd_documents, odd_rows
from tests.oracle import compare, connect

ITEMS = "item_id long, text string, score string"


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def brute(rows, items, top):
    """``rows`` of (key, text), ``items`` of (id, text): sorted (item, rank, key, score)."""
    counts = [(k, Counter(terms_of(x))) for k, x in rows]
    lengths = [sum(c.values()) for _, c in counts]
    number, words = sum(n > 0 for n in lengths), sum(lengths)
    df = Counter(t for _, c in counts for t in c)
    asked: dict = {}
    for i, x in items:
        asked.setdefault(i, set()).update(terms_of(x))
    result = []
    for i, terms in asked.items():
        found = []
        for (k, c), n in zip(counts, lengths, strict=True):
            m = 50 + (50 * n * number) // max(1, words)
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, k is None, k or 0))
        result += [(i, rank, None if none else k, -s) for rank, (s, none, k) in enumerate(sorted(found)[:top], 1)]
    return sorted(result, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("entries,items_at_once,block", [(1 << 20, 1024, 32), (500, 3, 4)])
def test_against_all_pairs(spark, entries, items_at_once, block):
    """Also with many shards and parts of items, hot terms and ties."""
    rng = random.Random(4)
    word = lambda: f"W{int(rng.paretovariate(0.6)) % 300}é" if rng.random() < 0.5 else rng.choice(["the", "of", "x-y"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25))), "") for i in range(10)] + [(99, rows[7][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lexical.ranked(docs, spark.createDataFrame(items, ITEMS), top=20, entries=entries, items_at_once=items_at_once, block=block, bits=1 << 12)
    assert rows_of(found) == brute(rows, [r[:2] for r in items], 20)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_rows()]
    items = [(0, "w1 w2, w3", "a"), (0, "W4", "b"), (1, None, "c"), (2, "", "d"), (3, "!?", "e"), (None, "w5 é", "f"), (4, "nowhere", "g"), (5, rows[-1][1], "h")]
    found = lexical.ranked(odd_documents(spark), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute(rows, [r[:2] for r in items], 50)
    empty = spark.createDataFrame([], ITEMS)
    assert lexical.ranked(no_documents(spark), spark.createDataFrame(items, ITEMS)).count() == 0
    assert lexical.ranked(odd_documents(spark), empty).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    run, sql = QUERIES["op11_lexical"]
    assert compare(run(spark, folder), connect(folder), sql) is None


def test_blocks_and_summaries():
    """Blocks hold each document of a list once, summaries bound them, and some blocks are skipped."""
    rng = np.random.default_rng(3)
    vocabulary = np.sort(rng.integers(-(2**62), 2**62, 400))
    vectors = []
    for i in range(900):  # three groups with terms of their own, and common terms
        own = rng.choice(np.arange(100, 200) + 100 * (i % 3), 20, replace=False)
        at = np.unique(np.r_[own, rng.choice(100, 10)])
        vectors.append((vocabulary[at], rng.integers(1, 4, len(at)), 100))
    shard = lexical.Shard(vocabulary, *(list(x) for x in list(zip(*vectors, strict=True))[:2]), np.full(900, 100))
    pure = []
    for term in range(0, 400, 7):
        docs, begins = shard.blocks(term, 16)
        assert sorted(docs) == [i for i, v in enumerate(vectors) if vocabulary[term] in v[0]]
        cols, values, starts = shard.summaries(docs, begins)
        ends, stops = np.r_[begins[1:], len(docs)], np.r_[starts[1:], len(cols)]
        for b in range(len(begins)):
            assert ends[b] - begins[b] <= 16
            top = dict(zip(cols[starts[b] : stops[b]], values[starts[b] : stops[b]], strict=True))
            inside = [(c, v) for d in docs[begins[b] : ends[b]] for c, v in zip(shard.columns[shard.bounds[d] : shard.bounds[d + 1]], shard.impacts[shard.bounds[d] : shard.bounds[d + 1]], strict=True)]
            assert {c: max(v for x, v in inside if x == c) for c, _ in inside} == top
            pure.append(max(Counter(docs[begins[b] : ends[b]] % 3).values()) / (ends[b] - begins[b]))
    assert np.mean(pure) > 0.6  # similar documents share blocks
    query = (vocabulary[np.r_[110:130, 5]], np.full(21, 1000))
    scored = []
    whole = lexical.Shard.scores
    try:
        lexical.Shard.scores = lambda self, docs, weights: scored.append(len(docs)) or whole(self, docs, weights)
        found = lexical.search_shard(vectors, [query], top=5, block=16)
    finally:
        lexical.Shard.scores = whole
    exact = [(int(1000 * shard.impacts[shard.bounds[d] : shard.bounds[d + 1]][np.isin(shard.columns[shard.bounds[d] : shard.bounds[d + 1]], np.r_[110:130, 5])].sum()), d) for d in range(900)]
    assert [(s, d) for _, d, s in found] == [(s, d) for s, d in sorted(exact, key=lambda x: (-x[0], x[1]))[:5]]
    assert sum(scored) < sum(s > 0 for s, _ in exact)
