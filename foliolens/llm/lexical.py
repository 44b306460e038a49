"""Ranked lexical search by per-term geometric blocking.

Documents become vectors of the impacts of their terms and are dealt to shards. In
a shard every term has a posting list, clustered by the similarity of its documents
and cut into blocks of at most ``BLOCK``; a block keeps the greatest impact of each
coordinate as its summary. An item goes through its terms by falling weight. A
block is skipped only if the item's product with the summary, which no document of
the block exceeds, is below the item's ``top``-th score so far; the documents of
the others are scored once. The remaining terms are left out when all of them
together can't reach that score. Bounds and scores are whole numbers, so the best
documents of a shard are exact, and the best of all are among them.

A shard holds about ``ENTRIES`` vector entries, however many documents there are;
items come to it ``ITEMS`` at a time. Terms are told apart by 64-bit hashes. Terms
that no item has are left out of the vectors: a bitmap of ``BITS`` bits, the same
size for any number of items, tells the tasks most of them.

Edge cases: null and empty texts, and texts without terms, are no documents. Items
without terms have no rows. Rows with the same key are documents of their own; null
keys come last among equal scores. Items that share an id are one item with all
their terms. Empty tables give empty results. Only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, small_batches, stored, utf8

TOP, BLOCK, ENTRIES, ITEMS = 50, 32, 1 << 20, 1024
BITS, SEED, SKETCH, KNOWN = 1 << 20, 42, 16, 1 << 20
#: Blocks whose documents are scored before the bound is looked at again.
STRIDE = 8

# Bytes that belong to terms are digits, letters (A-Z lower-cased) and all beyond ASCII.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class TermIds(dict):
    """Hashes of terms, as far as the bitmap holds them, else None."""

    def __init__(self, wanted: np.ndarray | None, bits: int):
        super().__init__()
        self._wanted, self._shift = wanted, 64 - bits.bit_length() + 1

    def __missing__(self, term: bytes) -> int | None:
        if len(self) >= KNOWN:
            self.clear()
        h = xxhash.xxh64_intdigest(term, SEED)
        found = None
        if self._wanted is None or self._wanted[h >> self._shift]:
            found = h - (1 << 64) if h >> 63 else h
        self[term] = found
        return found


def term_vectors(docs: DataFrame, key: str, text: str, wanted: np.ndarray | None = None, bits: int = BITS) -> DataFrame:
    """``k``, number of terms ``n`` and the wanted terms (hashes ``t``, counts ``c``) of each text."""
    rows = small_batches(docs).select(column(key).alias("k"), utf8(text).alias("x"))
    packed = None if wanted is None else np.packbits(wanted).tobytes()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool).tolist()
        ids = TermIds(marks, bits)
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for data in batch.column(1).to_pylist():
                found = [ids[w] for w in data.translate(BYTES).split()]
                t, c = np.unique(np.array([h for h in found if h is not None], np.int64), return_counts=True)
                sizes.append(len(found))
                ends.append(ends[-1] + len(t))
                terms.append(t)
                counts.append(c)
            at = pa.array(ends, pa.int32())
            lists = [
                pa.ListArray.from_arrays(at, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()))
                for x in (terms, counts)
            ]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["k", "n", "t", "c"])

    return rows.mapInArrow(vectors, f"k {rows.schema['k'].dataType.simpleString()}, n long, t array<long>, c array<long>")


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in all spans one after the other, and where each span begins in them."""
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - begins, sizes), begins


class Shard:
    """Vectors of documents over the terms ``vocabulary``, by document and by term."""

    def __init__(self, vocabulary: np.ndarray, terms: list, counts: list, lengths: np.ndarray):
        sizes = np.array([len(t) for t in terms], np.int64)
        all_terms = np.concatenate([*terms, np.zeros(0, np.int64)]).astype(np.int64)
        all_counts = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        at = np.minimum(np.searchsorted(vocabulary, all_terms), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == all_terms if len(vocabulary) else np.zeros(len(at), bool)
        owner = np.repeat(np.arange(len(terms)), sizes)[known]
        self.size, self.columns, tf = len(terms), at[known], all_counts[known]
        self.impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * lengths[owner])
        self.bounds = np.searchsorted(owner, np.arange(self.size + 1))
        order = np.argsort(self.columns, kind="stable")
        self.lists = np.searchsorted(self.columns[order], np.arange(len(vocabulary) + 1))
        self.postings = owner[order]
        self.greatest = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(self.greatest, self.columns, self.impacts)
        # A sketch of each document: random signs of its terms, taken from their hashes.
        bits = (vocabulary.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] >> np.arange(40, 40 + SKETCH, dtype=np.uint64)
        signs = (bits & np.uint64(1)).astype(np.float64) * 2 - 1
        self.sketches = np.zeros((self.size, SKETCH))
        for d in range(SKETCH):
            self.sketches[:, d] = np.bincount(owner, self.impacts * signs[self.columns, d], self.size)
        self.sketches /= np.maximum(1e-9, np.linalg.norm(self.sketches, axis=1, keepdims=True))

    def blocks(self, term: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The term's documents, those of a block next to each other, and where blocks begin.

        Centroids are documents spread over the list; each document joins the nearest.
        """
        docs = self.postings[self.lists[term] : self.lists[term + 1]]
        if len(docs) <= block:
            return docs, np.zeros(min(1, len(docs)), np.int64)
        number = math.isqrt(len(docs) // block) + 1
        centroids = self.sketches[docs[np.arange(number) * len(docs) // number]]
        nearest = np.argmax(self.sketches[docs] @ centroids.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        first = np.searchsorted(nearest, nearest)  # of the document's cluster
        return docs[order], np.flatnonzero((np.arange(len(docs)) - first) % block == 0)

    def summaries(self, docs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinatewise maxima of blocks: columns and values of all, and where each begins."""
        entries, _ = _spans(self.bounds[docs], self.bounds[docs + 1])
        block = np.repeat(np.searchsorted(begins, np.arange(len(docs)), side="right") - 1, self.bounds[docs + 1] - self.bounds[docs])
        order = np.lexsort((self.columns[entries], block))
        block, cols, values = block[order], self.columns[entries][order], self.impacts[entries][order]
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (cols[1:] != cols[:-1])])
        return cols[new], np.maximum.reduceat(values, new), np.searchsorted(block[new], np.arange(len(begins)))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        entries, begins = _spans(self.bounds[docs], self.bounds[docs + 1])
        return np.add.reduceat(weights[self.columns[entries]] * self.impacts[entries], begins)


class Item:
    """What an item has found in a shard so far."""

    def __init__(self, shard: Shard, columns: np.ndarray, weights: np.ndarray, size: int, top: int):
        self.columns, self.top = columns, top
        self.weights = np.zeros(size, np.int64)
        self.weights[columns] = weights
        self.rest = int((weights * shard.greatest[columns]).sum())
        self.seen = np.zeros(shard.size, bool)
        self.docs, self.found, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def look(self, shard: Shard, docs: np.ndarray, begins: np.ndarray, summary) -> None:
        """Scores the documents of all blocks whose summaries reach the least score that counts."""
        cols, values, starts = summary
        bounds = np.add.reduceat(self.weights[cols] * values, starts)
        ends = np.r_[begins[1:], len(docs)]
        order = np.argsort(-bounds, kind="stable")
        for i in range(0, len(order), STRIDE):
            here = order[i : i + STRIDE]
            here = here[bounds[here] >= self.least]
            if not len(here):
                break
            at, _ = _spans(begins[here], ends[here])
            new = docs[at][~self.seen[docs[at]]]
            if not len(new):
                continue
            self.seen[new] = True
            self._keep(new, shard.scores(new, self.weights))

    def _keep(self, docs: np.ndarray, found: np.ndarray) -> None:
        good = found >= self.least
        docs, found = np.r_[self.docs, docs[good]], np.r_[self.found, found[good]]
        order = np.lexsort((docs, -found))[: self.top]  # documents are numbered by their keys
        self.docs, self.found = docs[order], found[order]
        if len(order) == self.top:
            self.least = int(self.found[-1])


def search_shard(vectors: list[tuple], items: list[tuple], top: int = TOP, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """Best documents of each item: (item, document, score), by their places in the lists.

    ``vectors`` are (terms, counts, length), in the order of their keys; ``items`` are (terms, weights).
    """
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in items)]))
    shard = Shard(vocabulary, [v[0] for v in vectors], [v[1] for v in vectors], np.array([v[2] for v in vectors], np.int64))
    weights, wanted, asked = np.zeros(len(vocabulary), np.int64), [], [[] for _ in vocabulary]
    for terms, w in items:
        at = np.searchsorted(vocabulary, terms)
        weights[at] = w
        wanted.append(Item(shard, at, np.asarray(w, np.int64), len(vocabulary), top))
        for t in at:
            asked[t].append(wanted[-1])
    for term in np.lexsort((np.arange(len(vocabulary)), -weights)):
        share = int(weights[term] * shard.greatest[term])
        active = [i for i in asked[term] if i.rest >= i.least] if share else []
        if active:
            docs, begins = shard.blocks(term, block)
            summary = shard.summaries(docs, begins)
            for item in active:
                item.look(shard, docs, begins, summary)
        for item in asked[term]:
            item.rest -= share
    return [(i, int(d), int(s)) for i, item in enumerate(wanted) for d, s in zip(item.docs, item.found, strict=True)]


def ranked(
    docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text", top: int = TOP, block: int = BLOCK,
    entries: int = ENTRIES, items_at_once: int = ITEMS, bits: int = BITS,
) -> DataFrame:
    """Each item's ``top`` documents: ``item_id, rank, doc_id, score``."""
    asked = stored(term_vectors(items, item_key, item_text).select(F.col("k").alias("item"), F.explode("t").alias("t")).distinct())
    places = asked.select(F.shiftrightunsigned("t", 65 - bits.bit_length()).alias("b")).distinct()
    wanted = np.zeros(bits, bool)  # of fixed size, for any number of items
    wanted[[r["b"] for r in places.collect()]] = True
    vectors = stored(term_vectors(docs, key, text, wanted, bits))
    about = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("E"))
    number, words, held = about.first()
    df = vectors.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * number + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = asked.join(df, "t").withColumn("w", weight)
    # An item is as large as its text, not a group of rows.
    queries = weighed.groupBy("item").agg(F.collect_list(F.struct("t", "w")).alias("terms"))
    shards = max(1, -(-held // entries))
    parts = max(1, -(-asked.select("item").distinct().count() // items_at_once))
    length = F.expr(f"50 + CAST((CAST(50 * n AS decimal(20,0)) * CAST({number} AS decimal(18,0))) div {max(1, words)} AS long)")

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt = vectors.filter(F.size("t") > 0).select(
        "k", "t", "c", length.alias("m"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).alias("shard")
    )
    dealt = dealt.withColumn("part", each(parts)).withColumn("shard", F.col("shard").cast("int"))
    sent = queries.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int")).withColumn("shard", each(shards))

    def best(own: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("k", na_position="last", kind="stable")
        vectors = list(zip(own["t"], own["c"], own["m"], strict=True))
        split = [tuple(np.array([x[f] for x in terms], np.int64) for f in ("t", "w")) for terms in here["terms"]]
        found = search_shard(vectors, split, top, block)
        i, d, score = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pd.DataFrame({"item": here["item"].iloc[i].to_numpy(), "k": own["k"].iloc[d].to_numpy(), "score": np.array(score, np.int64)})

    kinds = [f.schema[c].dataType.simpleString() for f, c in ((items, item_key), (docs, key))]
    found = dealt.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(best, f"item {kinds[0]}, k {kinds[1]}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("k").asc_nulls_last())
    top_rows = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return top_rows.select(F.col("item").alias("item_id"), "rank", F.col("k").alias("doc_id"), "score")
