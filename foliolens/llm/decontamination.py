"""Benchmark decontamination by CGK embedding, bit sampling and edit verification.

Texts and items become lower-cased word sequences. A document leaks an item if
some run of its words is within ``(1 - SIMILARITY) * words`` word edits of it.

Candidates: windows as long as an item (items of nearly one length share a window
length and are compared by their beginnings) and item beginnings are embedded by
the CGK walk, which reads a sequence at a random pace that depends on the step
and the word, so that few edits leave the embeddings near in Hamming distance.
``WALKS`` walks with ``SAMPLES`` samples of ``BITS`` coordinates each are the LSH
tables; a window and an item that agree in a table are a candidate pair. Only
windows that can be within the number of edits are embedded: each edit costs
one word and two pairs of neighbours, so such a window has at least so many words
and pairs of the items of its length. Unknown words stand before and behind each text,
as many as there may be edits, so that its ends have all windows too. Candidates are verified by exact semi-global
edit distance around the window.

Items go out in blocks of ``ITEM_BLOCK`` (a bounded model for each pass over the
documents). A text's windows are made from number arrays, batch by batch.

Edge cases: null and empty texts leak nothing, items without a word are leaked by
no text; repeated items each count; rows sharing a key have a row each; empty
tables give empty results. Extra columns are carried by ``drop_leaks``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import column, fresh, small_batches

SIMILARITY = 0.8
WALKS, SAMPLES, BITS, PACES = 6, 12, 5, 4096
SIZE_STEP, SEED, ITEM_BLOCK = 1.15, 5, 5000
WINDOWS = 1 << 15  # embedded at once
TOKEN = re.compile(r"\w+")
FOUND = "array<struct<item: int, edits: int, words: int>>"
_PAST = -2  # what a walk reads behind the end of its sequence


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int(n * (1 - similarity) + 1e-9)


def embed(rows: np.ndarray, paces: np.ndarray, steps: list[int]) -> np.ndarray:
    """The coordinates ``steps`` of each row's CGK embedding of three times its length.

    ``paces``: of each step and word (by its remainder), whether the walk goes on to the next word.
    """
    m, n = rows.shape
    flat = np.concatenate([rows, np.full((m, 1), _PAST, rows.dtype)], axis=1).astype(np.int32).ravel()
    at = np.arange(m, dtype=np.int64) * (n + 1)
    end, wanted = at + n, set(steps)
    found = {}
    for j in range(max(steps) + 1):
        read = flat[at]
        if j in wanted:
            found[j] = read
        at += paces[j][read & (PACES - 1)]
        np.minimum(at, end, out=at)
    return np.stack([found[j] for j in steps], axis=1)


def best_alignment(item: np.ndarray, region: np.ndarray) -> int:
    """Least edit distance of the item to any run of the region."""
    ahead = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item, 1):
        cost = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (region != word))))
        row = np.minimum.accumulate(cost - ahead) + ahead
    return int(row.min())


class LeakFinder:
    """The tables of one block of items."""

    def __init__(self, items: list[str], similarity: float = SIMILARITY):
        self.vocabulary: dict[str, int] = {}
        put = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        self.items = [np.array([put(w) for w in words_of(x)], np.int64) for x in items]
        self.edits = [edits_allowed(len(x), similarity) for x in self.items]
        self.span = len(self.vocabulary) + 1
        self.classes = []
        self.made: dict[tuple[int, int], np.ndarray] = {}
        order = sorted((i for i, x in enumerate(self.items) if len(x)), key=lambda i: len(self.items[i]))
        while order:
            size = len(self.items[order[0]])
            own = [i for i in order if len(self.items[i]) <= size * SIZE_STEP]
            order = order[len(own) :]
            edits = max(self.edits[i] for i in own)
            words = np.zeros(self.span, bool)
            words[np.concatenate([self.items[i] for i in own])] = True
            pairs = np.unique(np.concatenate([self.items[i][:-1] * self.span + self.items[i][1:] for i in own]))
            beginnings = np.stack([self.items[i][:size] for i in own])
            rng = np.random.default_rng([SEED, size])
            tables = []
            for walk in range(WALKS):
                steps = [sorted(int(s) for s in rng.choice(3 * size, min(BITS, 3 * size), replace=False)) for _ in range(SAMPLES)]
                keys = self._keys(beginnings, walk, steps)
                tables.append((steps, [(np.sort(k), np.argsort(k, kind="stable")) for k in keys]))
            self.classes.append((size, edits, np.array(own), words, pairs, tables))

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def _paces(self, walk: int, size: int) -> np.ndarray:
        if (walk, size) not in self.made:
            self.made[walk, size] = np.random.default_rng([SEED, walk]).integers(0, 2, (3 * size, PACES), np.int8)
        return self.made[walk, size]

    def _keys(self, rows: np.ndarray, walk: int, steps: list[list[int]]) -> list[np.ndarray]:
        """Of each sample: a number for its coordinates."""
        every = sorted({s for sample in steps for s in sample})
        read = embed(rows, self._paces(walk, rows.shape[1]), every)
        where = {s: i for i, s in enumerate(every)}
        keys = []
        for sample in steps:
            key = np.zeros(len(rows), np.uint64)
            for s in sample:
                key = (key ^ read[:, where[s]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            keys.append(key)
        return keys

    def candidates(self, ids: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Rows (start, item), sorted: windows and items that agree in a table."""
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * self.span + ids[1:], -1)
        found = []
        for size, edits, own, words, pairs, tables in self.classes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            known = np.concatenate(([0], np.cumsum(words[ids], dtype=np.int32)))
            can = (known[size:] - known[:n] >= size - edits) & (text[size - 1 :] == text[:n])
            paired = np.zeros(len(pair), bool)
            if len(pairs):
                near = np.flatnonzero(words[ids[:-1]] & words[ids[1:]])
                paired[near] = pairs[np.minimum(np.searchsorted(pairs, pair[near]), len(pairs) - 1)] == pair[near]
            paired = np.concatenate(([0], np.cumsum(paired, dtype=np.int32)))
            can &= paired[size - 1 : size - 1 + n] - paired[:n] >= size - 1 - 2 * edits
            starts = np.flatnonzero(can)
            for begin in range(0, len(starts), WINDOWS):
                part = starts[begin : begin + WINDOWS]
                rows = ids[part[:, None] + np.arange(size)]
                for walk, (steps, sides) in enumerate(tables):
                    for key, (keys, who) in zip(self._keys(rows, walk, steps), sides, strict=True):
                        first, many = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
                        many -= first
                        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        found.append(np.stack([np.repeat(part, many), own[who[np.repeat(first, many) + nth]]], axis=1))
        return np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Per text: (item, edits, words of the item) of all leaked items."""
        get, parts = self.vocabulary.get, []
        for x in texts:
            words = words_of(x)
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int64, len(words)))
        if not any(map(len, parts)):
            return [[] for _ in texts]
        # Unknown words around each text: an item that lost words has all its windows at its ends too.
        around = np.full(max((c[1] for c in self.classes), default=0), -1, np.int64)
        ids = np.concatenate([x for p in parts for x in (around, p, around)])
        sizes = np.array([len(p) + 2 * len(around) for p in parts])
        text = np.repeat(np.arange(len(parts)), sizes)
        begins = np.cumsum(sizes) - sizes + len(around)
        ends = begins + sizes - 2 * len(around)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for start, item in self.candidates(ids, text).tolist():
            n, d, t = len(self.items[item]), self.edits[item], int(text[start])
            low, high = max(int(begins[t]), start - d), min(int(ends[t]), start + n + 2 * d)
            own = spans.setdefault((t, item), [])
            if own and low <= own[-1][1]:
                own[-1] = (own[-1][0], high)
            else:
                own.append((low, high))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (t, item), regions in sorted(spans.items()):
            words, most = self.items[item], self.edits[item]
            # Words that a region lacks are edits already: most regions need no alignment.
            near = [ids[low:high] for low, high in regions]
            near = [best_alignment(words, r) for r in near if np.count_nonzero(~np.isin(words, r)) <= most]
            if near and min(near) <= most:
                found[t].append((item, min(near), len(words)))
        return found


def _found_column(finder: LeakFinder, text: str) -> Column:
    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.Series:
        lists = finder.find(list(texts))
        return pd.Series([[{"item": i, "edits": e, "words": n} for i, e, n in own] for own in lists])

    return found(column(text).cast("string"))


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list]:
    """Keys and texts of the items, a bounded number at a time."""
    rows = items.select(column(item_key).alias("k"), column(item_text).cast("string").alias("x")).toLocalIterator()
    while block := list(islice(rows, ITEM_BLOCK)):
        yield block


def leaks(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id", item_text="text", similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of a document and an item that it leaks: ``k``, ``t`` (hash of the text),
    ``item``, ``edits`` and ``words`` (of the item)."""
    made = None
    kind = items.schema[item_key].dataType
    for block in _blocks(items, item_key, item_text):
        finder = LeakFinder([r["x"] for r in block], similarity)
        rows = small_batches(docs).select(column(key).alias("k"), F.xxhash64(column(text)).alias("t"), _found_column(finder, text).alias("f"))
        rows = rows.select("k", "t", F.explode("f").alias("f"))
        names = F.array(*[F.lit(r["k"]).cast(kind) for r in block])
        rows = rows.select("k", "t", F.get(names, "f.item").alias("item"), "f.edits", "f.words")
        made = rows if made is None else made.union(rows)
    if made is None:
        made = docs.select(column(key).alias("k"), F.xxhash64(column(text)).alias("t"), F.lit(None).cast(kind).alias("item"), F.lit(0).alias("edits"), F.lit(0).alias("words")).filter("false")
    return made


def drop_leaks(docs: DataFrame, items: DataFrame, text="text", item_key="item_id", item_text="text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that leak no item, with all their columns; nothing is shuffled."""
    kept = small_batches(docs)
    for block in _blocks(items, item_key, item_text):
        (name,) = fresh(kept, "found")
        finder = LeakFinder([r["x"] for r in block], similarity)
        kept = kept.withColumn(name, _found_column(finder, text)).filter(F.size(column(name)) == 0).drop(name)
    return kept
