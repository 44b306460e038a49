"""Phrases whose words occur together more often than apart, by HAT-trie counting.

Every task counts the phrases of its documents in a trie of word ids. Its leaves
are hash containers; one that grows past ``BURST`` entries bursts into a node with
a container for each next word. Ids are the task's own, so the trie needs no
dictionary of the corpus. A trie that holds ``ENTRIES`` entries spills whole
subtrees, the largest first: each is a run of phrases in order, sent as rows to the
partition of its prefix (the first ``PREFIX`` words of a phrase), where the counts
of all runs are merged. The rest of the trie is spilled at the end of the task.

Words are counted first. A phrase can only be frequent if all its parts are, so the
next two passes hash the pairs of frequent words, and the phrases of three to five
words whose pairs may be frequent, into 2**32 cells; tasks send their cells as sorted
arrays, by ranges of cells. Only phrases of cells with enough occurrences go to the
trie in the last pass. What is frequent goes to the tasks as one bitmap of ``BITS``
bits over hashes, whatever the size of the corpus: a false positive costs a counted
row, a false negative doesn't exist, so all counts that pass the threshold are exact.

Edge cases: null and empty texts, and pieces without words, count nothing. A null
language is ``und``. Repeated rows count each. Empty tables have no phrases. Ties
are ordered by the phrase. Only the columns named are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, small_batches, stored, utf8

LEAST, WORDS, TOP, SAME = 100, 5, 2000, 100
#: Entries of a container that bursts, and of a trie that spills; rows of a batch of a run.
BURST, ENTRIES, ROWS = 4096, 1 << 20, 1 << 14
BITS, PREFIX, SEED = 1 << 24, 3, 42
#: Bytes of texts whose words become ids at once; ids that wait until equal phrases are put together.
PART, WAITING = 1 << 21, 1 << 20
#: Cells that a task holds before it sends them; bits of a cell below its range.
CELLS, RANGE = 1 << 22, 22
#: Fixed value: an odd factor that mixes hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN, END = "und", b"\n"

# What separates pieces (all become line feeds) and words; only A-Z are lower-cased.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BYTES = bytes(10 if b in SEPARATORS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Node(dict):
    """Inner node of the trie: the next word's id to what lies below it. ``own`` counts the phrase that ends here."""

    own = 0


class HatTrie:
    """Counts of sequences of word ids: ``Node`` of nodes and of containers (``Counter`` of the rest of a sequence)."""

    def __init__(self, burst: int = BURST):
        self.root, self.entries, self._burst = Node(), 0, burst

    def add(self, ids: tuple[int, ...], n: int = 1) -> None:
        node, at, depth = self.root, self.root.get(ids[0]), 1
        while type(at) is Node:
            if depth == len(ids):
                self.entries += not at.own
                at.own += n
                return
            node, at, depth = at, at.get(ids[depth]), depth + 1
        if at is None:
            at = node[ids[depth - 1]] = Counter()
        rest = ids[depth:]
        before = len(at)
        at[rest] += n
        self.entries += len(at) - before
        if len(at) > self._burst:
            node[ids[depth - 1]] = self._split(at)

    def _split(self, container: Counter) -> Node:
        made = Node()
        made.own = container.pop((), 0)
        for rest, n in container.items():
            made.setdefault(rest[0], Counter())[rest[1:]] = n
        return made

    def subtrees(self) -> dict[int, int]:
        """Entries below each first word."""

        def size(at) -> int:
            return sum(map(size, at.values())) + bool(at.own) if type(at) is Node else len(at)

        return {first: size(at) for first, at in self.root.items()}

    def spill(self, first: int) -> list[tuple[tuple[int, ...], int]]:
        """Takes the subtree of a first word out of the trie."""
        found: list[tuple[tuple[int, ...], int]] = []

        def walk(at, before: tuple[int, ...]) -> None:
            if type(at) is not Node:
                found.extend((before + rest, n) for rest, n in at.items())
                return
            if at.own:
                found.append((before, at.own))
            for word, below in at.items():
                walk(below, (*before, word))

        walk(self.root.pop(first), (first,))
        self.entries -= len(found)
        return found


class Bitmap:
    """Hashes of phrases that may be frequent, of fixed size."""

    def __init__(self, longs: dict[int, int], bits: int):
        self._words = np.zeros(bits // 64, np.int64)
        self._words[list(longs)] = list(longs.values())
        self._words, self._bits = self._words.view(np.uint64), bits

    def __contains__(self, phrase: bytes) -> bool:
        return self.has(xxhash.xxh64_intdigest(phrase, SEED))

    def has(self, value: int) -> bool:
        at = value & (self._bits - 1)
        return bool(int(self._words[at >> 6]) >> (at & 63) & 1)

    def marked(self, values: np.ndarray) -> np.ndarray:
        """``has`` for many."""
        at = values & np.uint64(self._bits - 1)
        return (self._words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def bitmap(phrases: DataFrame, bits: int) -> Bitmap:
    """Of ``lang, phrase``."""
    return _bitmap(phrases, F.xxhash64(F.concat("lang", F.lit(" "), "phrase")), bits)


def _bitmap(rows: DataFrame, value: Column, bits: int) -> Bitmap:
    """Of the numbers of some rows; the driver gets ``bits / 64`` numbers at most."""
    longs = rows.select(value.bitwiseAND(F.lit(bits - 1)).alias("at")).groupBy(F.shiftright("at", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("w")
    )
    return Bitmap({r["i"]: r["w"] for r in longs.collect()}, bits)


class WordIds(dict):
    """A task's ids of words, from 1 on; 0 for what ends a phrase: a piece's end or a word that can't be frequent."""

    def __init__(self, lang: bytes, frequent: Bitmap | None):
        super().__init__({END: 0})
        self.words, self.hashes, self._lang, self._frequent = [END], [0], lang, frequent

    def __missing__(self, word: bytes) -> int:
        found, value = 0, xxhash.xxh64_intdigest(self._lang + b" " + word, SEED)
        if self._frequent is None or self._frequent.has(value):
            found = len(self.words)
            self.words.append(word)
            self.hashes.append(value)
        self[word] = found
        return found

    def of(self, data: bytes) -> np.ndarray:
        """The ids of a text, and 0 behind each piece; the text's words become ids a part at a time."""
        text, parts, begin = data.translate(BYTES).replace(b"\n", b" \n ") + b" \n ", [], 0
        while begin < len(text):
            end = text.find(b" ", begin + PART) + 1 or len(text)
            parts.append(self._part(text[begin:end]))
            begin = end
        return np.concatenate(parts)

    def _part(self, text: bytes) -> np.ndarray:
        """Equal words of up to seven bytes are looked up once: with the length they are a number."""
        blank = np.ones(len(text) + 2, np.int8)
        blank[1:-1] = np.frombuffer(text, np.uint8) == 32
        edges = np.flatnonzero(np.diff(blank))
        begins, ends = edges[::2], edges[1::2]
        length = (ends - begins).astype(np.uint64)
        few = length < 8
        ids, size = np.empty(len(begins), np.int64), length[few]
        key = np.ndarray(len(text), "<u8", text + bytes(8), 0, (1,))[begins[few]]
        key = key & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1)) | size << np.uint64(56)
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        ids[few] = self._look_up(text, begins[few][first], ends[few][first])[kind]
        ids[~few] = self._look_up(text, begins[~few], ends[~few])
        return ids

    def _look_up(self, text: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.array([self[text[b:e]] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)], np.int64)


class PhraseReader:
    """Reads one language's texts for phrases of ``low`` to ``high`` words.

    ``marks`` are the bitmaps of what may be frequent: words, pairs, longer phrases, as
    far as they are known. All parts of a phrase that is read are in them.
    """

    def __init__(self, lang: bytes, low: int, high: int, marks: tuple[Bitmap | None, ...]):
        self.ids = WordIds(lang, marks[0])
        self._low, self._high, self._lang, self._marks = low, high, lang, marks
        self._texts: list[bytes] = []
        self._waiting: list[np.ndarray] = []
        self._bytes = self._count = 0

    def add(self, data: bytes) -> None:
        self._texts.append(data)
        self._bytes += len(data)
        if self._bytes >= PART:
            self._read()
            if self._count >= WAITING:
                self.flush()

    def _read(self) -> None:
        self._waiting.append(self.ids.of(b"\n".join(self._texts)))
        self._count += len(self._waiting[-1])
        self._texts, self._bytes = [], 0

    def flush(self) -> None:
        """Takes the phrases of the texts that wait."""
        if self._texts:
            self._read()
        if self._waiting:
            ids, self._waiting, self._count = np.concatenate(self._waiting), [], 0
            self._take(ids)

    def _take(self, ids: np.ndarray) -> None:
        raise NotImplementedError

    def _phrases(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words from two on: where phrases begin, and the hashes of all places."""
        words = np.array(self.ids.hashes, np.uint64)[ids]
        whole, hashes = ids > 0, words
        for k in range(2, self._high + 1):
            whole = whole[:-1] & whole[1:]
            hashes = (hashes[:-1] ^ hashes[:-1] >> np.uint64(32)) * STEP + words[k - 1 :]
            if min(k, 3) <= len(self._marks):
                begins = np.flatnonzero(whole)
                whole[begins] = self._marks[min(k, 3) - 1].marked(hashes[begins] >> np.uint64(32))
            yield k, np.flatnonzero(whole), hashes

    @property
    def waits(self) -> bool:
        return bool(self._waiting or self._texts)

    def forget(self) -> None:
        """Words that nothing refers to need no ids any more."""
        self.ids = WordIds(self._lang, self._marks[0])


class PhraseCounter(PhraseReader):
    """Counts phrases in a trie."""

    def __init__(self, lang: bytes, low: int, high: int, marks: tuple[Bitmap | None, ...], burst: int):
        super().__init__(lang, low, high, marks)
        self.trie, self.words = HatTrie(burst), 0

    def _take(self, ids: np.ndarray) -> None:
        """Adds phrases to the trie, equal ones together."""
        if self._low == 1:
            counts = np.bincount(ids)
            counts[0] = 0
            self.words += int(counts.sum())
            found = np.flatnonzero(counts)
            self._add(found[:, None], counts[found])
        same = ids  # number of the phrase of one word less that begins here
        for k, begins, _ in self._phrases(ids) if self._high > 1 else ():
            _, first, kind, counts = np.unique(same[begins] << 32 | ids[begins + k - 1], return_index=True, return_inverse=True, return_counts=True)
            same = np.zeros(len(ids), np.int64)
            same[begins] = kind
            if k >= self._low:
                self._add(ids[begins[first][:, None] + np.arange(k)], counts)

    def _add(self, phrases: np.ndarray, counts: np.ndarray) -> None:
        for row, n in zip(phrases.tolist(), counts.tolist(), strict=True):
            self.trie.add(tuple(row), n)


class PhraseHasher(PhraseReader):
    """Keeps the cells of phrases."""

    def __init__(self, lang: bytes, low: int, high: int, marks: tuple[Bitmap | None, ...]):
        super().__init__(lang, low, high, marks)
        self.cells: list[np.ndarray] = []

    def _take(self, ids: np.ndarray) -> None:
        for k, begins, hashes in self._phrases(ids):
            if k >= self._low:
                self.cells.append((hashes[begins] >> np.uint64(32)).astype("<u4"))


def hashed(docs: DataFrame, low: int, high: int, *marks: Bitmap | None, least: int, entries: int = ENTRIES) -> DataFrame:
    """The cells (``cell``) with ``least`` or more of the phrases of ``docs`` (``lang``, ``x`` bytes)."""
    few = np.min_scalar_type(least)  # no more than least is added up of a task: that is enough

    def rows(readers: dict[bytes, PhraseHasher]) -> Iterator[pa.RecordBatch]:
        """Sorted cells below their range, the bytes of each place together, and their counts."""
        for r in readers.values():
            r.flush()
        cells, n = np.unique(np.concatenate([c for r in readers.values() for c in r.cells] or [np.empty(0, "<u4")]), return_counts=True)
        for r in readers.values():
            r.cells = []
        n = np.minimum(n, least).astype(few)
        spans = cells >> RANGE
        edges = np.flatnonzero(np.r_[True, spans[1:] != spans[:-1], True]).tolist() if len(cells) else [0]
        low_bits = cells & np.uint32((1 << RANGE) - 1)
        data = [
            (int(spans[b]), low_bits[b:e].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), n[b:e].tobytes())
            for b, e in zip(edges[:-1], edges[1:], strict=True)
        ]
        if data:
            columns = zip(*data, strict=True)
            types = (pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["span", "cells", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[bytes, PhraseHasher] = {}
        for given in batches:
            for lang, data in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                own = lang.encode()
                if own not in readers:
                    readers[own] = PhraseHasher(own, low, high, marks)
                readers[own].add(data)
            if sum(len(c) for r in readers.values() for c in r.cells) > CELLS:
                yield from rows(readers)
            if sum(len(r.ids) for r in readers.values()) > 2 * entries:
                for r in readers.values():
                    r.flush()
                    r.forget()
        yield from rows(readers)

    def merged(span: int, cells: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        together, kind = np.unique(np.concatenate(cells), return_inverse=True)
        found = together[np.bincount(kind, np.concatenate(n)) >= least].astype(np.int64)
        return pa.record_batch([pa.array(found | span << RANGE)], names=["cell"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cells, n = None, [], []
        for given in batches:
            for span, some, counts in zip(*(c.to_pylist() for c in given.columns), strict=True):
                if span != at and cells:
                    yield merged(at, cells, n)
                    cells, n = [], []
                at = span
                cells.append(np.ascontiguousarray(np.frombuffer(some, np.uint8).reshape(4, -1).T).view("<u4").ravel())
                n.append(np.frombuffer(counts, few))
        if cells:
            yield merged(at, cells, n)

    sent = docs.mapInArrow(read, "span int, cells binary, n binary")
    return sent.repartition("span").sortWithinPartitions("span").mapInArrow(merge, "cell long")


def counted(docs: DataFrame, low: int, high: int, *marks: Bitmap | None, entries: int = ENTRIES, burst: int = BURST) -> DataFrame:
    """Counts ``n`` of the phrases of ``docs`` (``lang``, ``x`` bytes): ``lang, phrase, n``. With words the empty
    phrase counts them all."""

    def runs(counters: dict[bytes, PhraseCounter], keep: int) -> Iterator[pa.RecordBatch]:
        """Spills the largest subtrees until at most ``keep`` entries are left."""
        sizes = [(n, lang, first) for lang, c in counters.items() for first, n in c.trie.subtrees().items()]
        left, rows = sum(n for n, _, _ in sizes), []
        for n, lang, first in sorted(sizes, reverse=True):
            if left <= keep:
                break
            left -= n
            words = counters[lang].ids.words
            texts = [(lang, b" ".join([words[i] for i in ids]), m) for ids, m in counters[lang].trie.spill(first)]
            rows += sorted(texts)
            while len(rows) >= ROWS:
                yield batch(rows[:ROWS])
                del rows[:ROWS]
        if rows:
            yield batch(rows)
        for c in counters.values():
            if not c.trie.entries and not c.waits:
                c.forget()

    def batch(rows: list[tuple[bytes, bytes, int]]) -> pa.RecordBatch:
        langs, phrases, n = zip(*rows, strict=True)
        text = [pa.array(x, pa.binary()).cast(pa.string()) for x in (langs, phrases)]
        return pa.record_batch([*text, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[bytes, PhraseCounter] = {}
        for given in batches:
            for lang, data in zip(given.column(0).to_pylist(), given.column(1).to_pylist(), strict=True):
                own = lang.encode()
                if own not in counters:
                    counters[own] = PhraseCounter(own, low, high, marks, burst)
                counters[own].add(data)
                if sum(c.trie.entries for c in counters.values()) > entries:
                    yield from runs(counters, entries // 2)
                if sum(len(c.ids) for c in counters.values()) > 2 * entries:
                    for c in counters.values():
                        c.flush()
                    yield from runs(counters, 0)
        for c in counters.values():
            c.flush()
        yield from runs(counters, 0)
        if totals := [(lang, b"", c.words) for lang, c in counters.items() if c.words]:
            yield batch(totals)

    rows = docs.mapInArrow(count, "lang string, phrase string, n long")
    if high <= PREFIX:
        return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    placed = rows.withColumn("prefix", F.substring_index("phrase", " ", PREFIX)).repartition("lang", "prefix")
    return placed.groupBy("lang", "prefix", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def phrase_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, bits: int = BITS,
    entries: int = ENTRIES, burst: int = BURST,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``words`` words that occur ``least`` times or more (``lang, phrase, n``, exact),
    and the words of each language (``lang, n``)."""
    body = small_batches(docs).select(F.coalesce(column(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), utf8(text).alias("x"))
    single = stored(counted(body, 1, 1, None, entries=entries, burst=burst).filter((F.col("n") >= least) | (F.col("phrase") == "")))
    frequent, sizes = single.filter("phrase <> ''"), single.filter("phrase = ''").select("lang", "n")
    marks = [bitmap(frequent, bits)]
    for low, high in ((2, 2), (3, words)):
        if low <= high <= words:
            marks.append(_bitmap(hashed(body, low, high, *marks, least=least, entries=entries), F.col("cell"), bits))
    if words < 2:
        return frequent, sizes
    longer = stored(counted(body, 2, words, *marks, entries=entries, burst=burst).filter(F.col("n") >= least))
    return frequent.unionByName(longer), sizes


def _part(phrase: str, first: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, words), " ")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, same: int = SAME,
    **how,
) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase's score is that of its worst cut, ``1000 * a * n div (l * r)`` in exact
    decimals. A phrase is left out if a longer one holds it in ``same`` percent of
    its occurrences.
    """
    counts, sizes = phrase_counts(docs, text, lang, least, words, **how)
    counts = counts.withColumn("k", F.size(F.split("phrase", " ")))
    phrases = counts.filter("k > 1").withColumnRenamed("n", "a")

    def parts(name: str, count: str) -> DataFrame:
        return counts.filter(F.col("k") < words).select("lang", F.col("phrase").alias(name), F.col("n").alias(count))

    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumn("first", _part("phrase", F.lit(1), F.col("cut"))).withColumn("rest", _part("phrase", F.col("cut") + 1, F.col("k") - F.col("cut")))
    met = cuts.join(parts("first", "l"), ["lang", "first"]).join(parts("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    exact = "CAST((CAST(1000 * CAST(a AS decimal(19,0)) AS decimal(23,0)) * CAST(n AS decimal(15,0))) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS long)"
    scored = met.withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "phrase", "a", "n", "k").agg(F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    inner = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("k") - 1),
                lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: _part("phrase", i, m)),
            )
        )
    )
    longer = phrases.filter("k > 2").select("lang", F.col("a").alias("longer"), inner.alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = worst.join(held, ["lang", "phrase"], "left").filter(~F.coalesce(F.col("longer") * 100 >= F.col("a") * same, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    flat = kept.select("lang", "phrase", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), "n", F.col("w.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
