from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolens.llm import nearest as ann
from foliolens.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(ids, x, queries, k):
    found = {}
    for q in queries:
        exact = ann.fixed_order_products(np.broadcast_to(x[q], x.shape), x)
        order = [i for i in np.lexsort((ids, -exact)) if ids[i] != ids[q]][:k]
        found[int(ids[q])] = [(int(ids[i]), float(exact[i])) for i in order]
    return found


def test_recall_and_scores(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.toPandas()
    ids, x = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    products = {int(i): v for i, v in zip(ids, x, strict=True)}
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == ann.fixed_order_products(products[q][None], products[v][None])[0] for v, s in found)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_pairs_are_visited_in_order():
    rng = np.random.default_rng(2)
    index = ann.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    query = rng.normal(size=6)
    visited = list(index.visits(query))
    sums = [index.first[i] @ query[:3] + index.second[j] @ query[3:] for i, j in visited]
    assert len(set(visited)) == 35 and sums == sorted(sums, reverse=True)


@pytest.mark.parametrize("block,scores", [(1 << 20, 1 << 22), (4 * 8 * 4, 8)])
def test_ties_split_blocks_and_odd_vectors(spark, monkeypatch, block, scores):
    monkeypatch.setattr(ann, "BLOCK_BYTES", block)
    monkeypatch.setattr(ann, "SCORES", scores)
    same = [(i, [1.0, 0.5, 0.25, 0.0]) for i in range(60)]
    odd = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 1.0]), (105, [1.0]), (None, [1.0, 0.0, 0.0, 0.0]), (5, [1.0, 0.5, 0.25, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in [*same, *odd]], SCHEMA)
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    for q in (0, 20, 40):
        assert [r["vec_id"] for r in found if r["query_id"] == q] == [i for i in range(22) if i != q][:20]
    assert {r["query_id"] for r in found} == {0, 20, 40}


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "", ""), (1, [2.0, 1.0], "", "")], SCHEMA)
    (r,) = ann.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert (r["query_id"], r["rank"], r["vec_id"], r["score"]) == (0, 1, 1, 4.0)
    assert ann.nearest(df.filter("false"), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.filter("vec_id = 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_component(spark):
    df = spark.createDataFrame([(i, [float(i % 7 - 3)], "", "") for i in range(50)], SCHEMA)
    ids = np.arange(50)
    want = brute(ids, (ids % 7 - 3.0)[:, None], [20, 40], 20)
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    none = {i for i in range(50) if i % 7 == 3}  # zero vectors
    assert set(got) == {0, 20, 40}
    for q, found in want.items():
        assert got[q][0] == next(f for f in found if f[0] not in none)
        assert all(s == (q % 7 - 3.0) * (v % 7 - 3.0) for v, s in got[q])


def test_splits_answer_like_one_block(spark, monkeypatch):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    ask = lambda: ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    whole = ask()
    monkeypatch.setattr(ann, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(ann, "SCORES", 50)
    assert ask() == whole
