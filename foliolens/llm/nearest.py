"""Approximate nearest neighbours by largest inner product: an inverted multi-index.

Vectors are split into two halves, each quantised by its own k-means centroids; a
cell is a pair of centroids. For a query, pairs are visited in the order of their
summed inner products with its halves, by a heap over the two sorted lists, until
the visited cells hold ``share`` of all entries (at least ``k`` others); the entries
of these cells are ranked by their exact inner product.

The centroids and the share are fitted on at most ``SAMPLE`` vectors (least hash of
the key): the share is the least that finds ``RECALL`` of the true neighbours of
``TRIALS`` sampled queries among the sample. Every vector is indexed. Larger
tables have nearer neighbours, for which the same share finds more.

Cells of one first centroid are a block; blocks of more than ``BLOCK_BYTES`` of
vectors are split by the hash of their keys. An entry goes to its block alone. A query
goes to the blocks that hold cells which it visits, and a task reads its blocks in
order, entries before queries: it holds one block and a batch of queries, however
many queries there are. Tables of more than a million vectors have more centroids (the
fourth root of their number). Scores of the best are summed in one fixed order in double
precision, so equal vectors have equal scores in whatever block they are.

Edge cases: vectors that are null, zero, hold null or non-finite components or
have another length than most take no part; rows with a query's own key are no
candidates of it; ties go to the smaller key; with fewer candidates than ``k`` all
are returned. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, small_batches, stored

K, CENTROIDS, ROUNDS, SEED = 20, 32, 12, 3
SAMPLE, TRIALS, RECALL = 10_000, 200, 0.97
BLOCK_BYTES, SCORES = 32 << 20, 1 << 22  # of a block's vectors; scores that are held at once
#: Relative to the largest product: what sums in another order may differ by.
SLACK = 1e-9


def k_means(points: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    if not points.shape[1]:  # the first half of one component
        return np.zeros((min(1, len(points)), 0))
    rng = np.random.default_rng(seed)
    points = points[np.lexsort(points.T)]
    centroids = np.unique(points, axis=0)
    if len(centroids) > k:
        centroids = centroids[rng.choice(len(centroids), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest_centroid(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centroids))
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def nearest_centroid(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * points @ centroids.T, axis=1)


def fixed_order_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


class MultiIndex:
    """Centroids of both halves, entries of each cell and the share to visit."""

    def __init__(self, first: np.ndarray, second: np.ndarray, share: float = 1.0, counts: np.ndarray | None = None):
        self.first, self.second, self.share = first, second, share
        self.counts = counts  # of each pair of centroids
        self.half = first.shape[1]

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest_centroid(points[:, : self.half], self.first), nearest_centroid(points[:, self.half :], self.second)

    def visits(self, query: np.ndarray):
        """Cells in the order of their summed products."""
        one, two = self.first @ query[: self.half], self.second @ query[self.half :]
        a, b = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        one, two = one[a], two[b]
        heap = [(-(one[0] + two[0]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(a[i]), int(b[j])
            if j + 1 < len(b):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))

    def probed(self, query: np.ndarray, k: int) -> dict[int, list[int]]:
        """Second centroids to visit, by first."""
        enough = max(k + 1, int(np.ceil(self.share * self.counts.sum())))
        held, found = 0, {}
        for i, j in self.visits(query):
            if self.counts[i, j]:
                found.setdefault(i, []).append(j)
                held += int(self.counts[i, j])
                if held >= enough:
                    break
        return found


def fit_index(sample: np.ndarray, k: int = K, centroids: int = CENTROIDS) -> MultiIndex:
    """Centroids, and the least share of the sample that holds enough true neighbours."""
    half = sample.shape[1] // 2
    index = MultiIndex(k_means(sample[:, :half], centroids), k_means(sample[:, half:], centroids))
    one, two = index.cells(sample)
    shape = len(index.first), len(index.second)
    counts = np.bincount(one * shape[1] + two, minlength=shape[0] * shape[1])
    rng = np.random.default_rng(SEED)
    needed = []
    for q in rng.choice(len(sample), min(TRIALS, len(sample)), replace=False):
        scores = sample @ sample[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(sample) - 1)]
        seen, upto = np.zeros(shape[0] * shape[1]), 0
        for i, j in index.visits(sample[q]):
            upto += counts[i * shape[1] + j]
            seen[i * shape[1] + j] = upto
        needed += (seen[one[best] * shape[1] + two[best]] / len(sample)).tolist()
    index.share = float(np.quantile(needed, RECALL, method="higher")) if needed else 1.0
    return index


def _valid(vector: str) -> Column:
    v = column(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)


def _best(entry_ids, vectors, query_ids, queries, allowed, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best allowed candidates of each query, ties to smaller keys: queries, entries, scores."""
    scores = queries @ vectors.T
    scores[~allowed | (query_ids[:, None] == entry_ids[None, :])] = -np.inf
    slack = SLACK * max(1.0, float(np.abs(queries).max() * np.abs(vectors).max()) * vectors.shape[1])
    asked, found, products = [], [], []
    for q, own in enumerate(scores):
        least = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
        near = np.flatnonzero((own >= least - slack) & (own > -np.inf))
        exact = fixed_order_products(np.broadcast_to(queries[q], (len(near), queries.shape[1])), vectors[near])
        order = np.lexsort((entry_ids[near], -exact))[:k]
        asked.append(np.full(len(order), query_ids[q]))
        found.append(entry_ids[near][order])
        products.append(exact[order])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(products)


class _Block:
    """The entries of one block, and the queries that come after them."""

    def __init__(self, seconds: int, k: int):
        self.seconds, self.k = seconds, k
        self.ids, self.vectors, self.cells = [], [], []

    def add(self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray) -> None:
        self.ids.append(ids)
        self.vectors.append(vectors)
        self.cells.append(cells)

    def answers(self, ids: np.ndarray, vectors: np.ndarray, many: np.ndarray, cells: np.ndarray) -> Iterator[tuple]:
        """Best entries of each query; it visits ``many`` of the ``cells``."""
        if len(self.ids) > 1:
            self.ids, self.vectors, self.cells = ([np.concatenate(x)] for x in (self.ids, self.vectors, self.cells))
        if not self.ids:
            return
        visited = np.zeros((len(ids), self.seconds), bool)
        visited[np.repeat(np.arange(len(ids)), many), cells] = True
        step = max(1, SCORES // len(self.ids[0]))
        for at in range(0, len(ids), step):
            part = slice(at, at + step)
            yield _best(self.ids[0], self.vectors[0], ids[part], vectors[part], visited[part][:, self.cells[0]], self.k)


def _answered(seconds: int, k: int):
    """Reads rows that are sorted by block, entries first, and gives the best entries of each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            numbers = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy()
            vectors = batch.column(3).flatten().to_numpy().reshape(n, -1)
            many = batch.column(4).value_lengths().to_numpy()
            cells, ends = batch.column(4).flatten().to_numpy(), np.concatenate(([0], np.cumsum(many)))
            turns = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns], [*turns, n], strict=True):
                if numbers[a] != number:
                    number, block = numbers[a], _Block(seconds, k)
                own = cells[ends[a] : ends[b]]
                if not asks[a]:
                    block.add(ids[a:b], vectors[a:b], own)
                    continue
                for found in block.answers(ids[a:b], vectors[a:b], many[a:b], own):
                    yield pa.record_batch([pa.array(x) for x in found], names=["q", "v", "score"])

    return run


def nearest(vectors: DataFrame, is_query: Column, key="vec_id", vector="embedding", k: int = K) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k nearest found of each query row."""
    spark = vectors.sparkSession
    rows = vectors.select(column(key).cast("long").alias("v"), column(vector).cast("array<double>").alias("x"), is_query.alias("isq"))
    rows = rows.filter(_valid("x") & F.col("v").isNotNull())
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.dropDuplicates(["v", "x"]))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return empty
    rows = rows.filter(F.size("x") == length["d"])
    sample = rows.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("x").collect()  # of bounded size
    index = fit_index(np.array([r["x"] for r in sample]), k, max(CENTROIDS, math.ceil(length["count"] ** 0.25)))

    @F.pandas_udf("c1 int, c2 int")
    def cell(xs: pd.Series) -> pd.DataFrame:
        one, two = index.cells(np.stack(xs.tolist()))
        return pd.DataFrame({"c1": one.astype(np.int32), "c2": two.astype(np.int32)})

    entries = stored(small_batches(rows).withColumn("c", cell("x")).select("v", "x", "isq", "c.c1", "c.c2"))
    counts = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in entries.groupBy("c1", "c2").count().collect():  # one row for each cell
        counts[r["c1"], r["c2"]] = r["count"]
    index.counts = counts
    most = max(1, BLOCK_BYTES // (8 * length["d"]))
    splits = [max(1, -(-int(n) // most)) for n in counts.sum(1)]
    begins = np.concatenate(([0], np.cumsum(splits))).tolist()
    of = lambda numbers: F.element_at(F.array(*map(F.lit, numbers)), F.col("c1") + 1)

    def probe(batches):
        for pdf in batches:
            found = [(q, y, i, js) for q, y in zip(pdf["q"], pdf["y"], strict=True) for i, js in index.probed(np.asarray(y), k).items()]
            yield pd.DataFrame(found, columns=["q", "y", "c1", "js"])

    wanted = entries.filter("isq").select(F.col("v").alias("q"), F.col("x").alias("y"))
    probes = wanted.mapInPandas(probe, "q long, y array<double>, c1 int, js array<int>")
    probes = probes.select(
        F.explode(F.sequence(of(begins), of(begins[1:]) - 1)).alias("block"), F.lit(True).alias("asks"), F.col("q").alias("v"), F.col("y").alias("x"), F.col("js").alias("cells")
    )
    own = of(begins) + F.pmod(F.xxhash64("v"), of(splits)).cast("int")
    held = entries.select(own.alias("block"), F.lit(False).alias("asks"), "v", "x", F.array("c2").alias("cells"))
    dealt = held.unionByName(probes).repartition(begins[-1], "block").sortWithinPartitions("block", "asks")
    best = small_batches(dealt).mapInArrow(_answered(len(index.second), k), "q long, v long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "v")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), "score")
