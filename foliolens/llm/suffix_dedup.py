"""Suffix dedup: bytes covered by a string of ``LENGTH`` that also starts earlier.

The plan follows induced suffix sorting with what Spark has for its parts. A
content-defined sample of suffixes is sorted first, the others get their order
and their common prefixes from it, and what moves are tuples of fixed size
through shuffles that spill to disk, so a shard may be far larger than memory:

1. *Sample.* Every window of ``LENGTH`` bytes is represented by the suffix at its
   least ``SEED_BYTES``-gram (by hash, the leftmost of equals). Neighbouring
   windows share it: a tuple is the sampled suffix's name (the gram's hash), the
   run of windows and a second name for all bytes the run covers. Equal windows
   have equal sampled suffixes at equal offsets.
2. *Sort.* Tuples are brought together by their first name. Names that occur once
   can't be in a repeat and end here.
3. *Recursion.* Within a name, tuples are named again by all they cover. All but
   the first tuple of a class are repeats as a whole: the common prefix with the
   first is the entire run.
4. *Induction.* First tuples of a name with several classes agree in part only:
   for these the windows themselves, that is the suffixes next to the sampled one
   and what they share with it, are named and compared: per name in one task, or by
   a shuffle of windows for names with more than ``HOT`` classes. Both are exact.

Equality is decided by two independent 64-bit polynomial hashes (the sampled gram
and the covered bytes). Nothing is enumerated in pairs: first occurrences are
partial aggregates, and joins can be split by adaptive execution. The README
tells how this differs from sorting every suffix and why.

Edge cases: null texts count as empty; texts under ``LENGTH`` bytes lose nothing;
texts over ``BLOCK`` bytes are sampled in overlapping blocks. Rows that share key
and text are one occurrence and lose the same bytes; a null key sorts first.
Matches don't cross documents. Extra columns are no input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import column, small_batches, stored, utf8

LENGTH, SEED_BYTES = 100, 32
BLOCK = 1 << 20
_AT = (1 << 21) - 1
#: Names with more classes compare their windows by a shuffle, others in one task, so many tuples at once.
HOT, TOGETHER = 4096, 1024
FIRST, SECOND = 11, 12  # seeds of the two hashes


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)


class Rolling:
    """Hashes of any substring of a block, from sums of value times power modulo 2^64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, np.uint64)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5 & (1 << 64) - 1
        self._reach(BLOCK)

    def _reach(self, most: int) -> None:
        steps = np.full(most + 1, self.base, np.uint64)
        steps[0] = 1
        self.up = np.cumprod(steps)
        steps[1:] = pow(self.base, -1, 1 << 64)
        self.down = np.cumprod(steps)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._reach(2 * len(data))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.up[: len(data)], dtype=np.uint64)))

    def of(self, sums: np.ndarray, begin: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        where = begin if isinstance(begin, np.ndarray) else slice(begin.start, begin.stop)
        return _mixed((sums[end] - sums[begin]) * self.down[where])


def sample_runs(data: np.ndarray, doc: np.ndarray, first: Rolling, second: Rolling | None, length: int = LENGTH, gram: int = SEED_BYTES):
    """Runs of windows that share a sampled suffix: begin, number of windows, names.

    ``doc``: of each byte the number of its document. Without ``second`` the first names only.
    """
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    sums = first.sums(data)
    last = len(data) - gram + 1
    hashed = first.of(sums, slice(0, last), slice(gram, gram + last))
    least = hashed & ~np.uint64(_AT) | np.arange(last, dtype=np.uint64)
    width, wide = 1, length - gram + 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = (least & np.uint64(_AT)).astype(np.int64)
    valid = doc[length - 1 :] == doc[:n]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | ~valid[:-1]))
    begin = np.flatnonzero(new & valid)
    stops = np.append(np.flatnonzero(new | ~valid), n)
    end = stops[np.searchsorted(stops, begin, "right")]
    names = hashed[at[begin]].view(np.int64)
    if second is None:
        return begin, end - begin, names, names
    whole = second.of(second.sums(data), begin, end + length - 1)
    place = ((at[begin] - begin) << 8 | (end - begin)).astype(np.uint64)
    return begin, end - begin, names, _mixed(whole ^ place * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts (last column): bytes of a block, row of each, and the row's offset of the block's first byte of it."""
    texts = batch.column(batch.num_columns - 1)
    held, rows, size = [], [], 0
    for i in range(batch.num_rows):
        text = np.frombuffer(texts[i].as_buffer(), np.uint8) if len(texts[i].as_buffer()) else np.zeros(0, np.uint8)
        if len(text) < length:
            continue
        for begin in range(0, len(text) - length + 1, BLOCK - length + 1):
            part = text[begin : begin + BLOCK]
            if size + len(part) > BLOCK:
                yield _joined(held, rows)
                held, rows, size = [], [], 0
            held.append(part)
            rows.append((i, begin))
            size += len(part)
    if held:
        yield _joined(held, rows)


def _joined(held: list[np.ndarray], rows: list[tuple[int, int]]):
    sizes = [len(x) for x in held]
    begins = np.cumsum([0, *sizes[:-1]])
    return np.concatenate(held), np.repeat(np.arange(len(held)), sizes), (np.array([r for r, _ in rows]), np.array([b for _, b in rows]) - begins)


def _sampled(docs: DataFrame, length: int, gram: int, all_columns: bool) -> DataFrame:
    """Tuples ``a`` (first name), and if wanted ``k, t, s`` (begin), ``n`` (windows) and ``c`` (second name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Rolling(FIRST), Rolling(SECOND) if all_columns else None
        for batch in batches:
            for data, part, (row, shift) in _blocks(batch, length):
                begin, n, a, c = sample_runs(data, part, first, second, length, gram)
                if not all_columns:
                    yield pa.record_batch([pa.array(a)], names=["a"])
                    continue
                part = part[begin]
                keys = [batch.column(i).take(pa.array(row[part])) for i in (0, 1)]
                yield pa.record_batch([*keys, pa.array(begin + shift[part]), pa.array(n.astype(np.int32)), pa.array(a), pa.array(c)], names=["k", "t", "s", "n", "a", "c"])

    kind = docs.schema["k"].dataType.simpleString()
    schema = f"k {kind}, t long, s long, n int, a long, c long" if all_columns else "a long"
    return docs.mapInArrow(run, schema)


def _snippets(met: DataFrame, length: int) -> DataFrame:
    """Of texts with ``runs`` (begin, windows, first name, hot): what each run covers, as ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            for i, runs in enumerate(batch.column(2).to_pylist()):
                data = texts[i].as_buffer().to_pybytes()
                keys = [batch.column(c).take(pa.array(np.full(len(runs), i))) for c in (0, 1)]
                own = [pa.array([r[f] for r in runs], kind) for f, kind in (("s", pa.int64()), ("n", pa.int32()), ("a", pa.int64()), ("hot", pa.bool_()))]
                cover = pa.array([data[r["s"] : r["s"] + r["n"] + length - 1] for r in runs], pa.binary())
                yield pa.record_batch([*keys, *own, cover], names=["k", "t", "s", "n", "a", "hot", "x"])

    return met.mapInArrow(run, f"k {met.schema['k'].dataType.simpleString()}, t long, s long, n int, a long, hot boolean, x binary")


def _named_windows(second: Rolling, batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the rows' snippets: its row, its begin in the text and its name."""
    n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8)
    begins = np.cumsum(n + length - 1) - (n + length - 1)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = begins[row] + inside
    names = second.of(second.sums(data), at, at + length).view(np.int64)
    return row, batch.column("s").to_numpy(zero_copy_only=False)[row] + inside, names


def _later_runs(second: Rolling, batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Spans of windows that an earlier row or place of the same first name has as well."""
    row, s, w = _named_windows(second, batch, length)
    a = batch.column("a").to_numpy(zero_copy_only=False)[row]
    keys = batch.column("k").to_pandas()
    rank = keys.rank(method="dense", na_option="top").to_numpy()[row]
    order = np.lexsort((s, rank, w, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (w[order][1:] != w[order][:-1])))
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(row), bool)
    later[order] = (rank[order] != rank[first]) | (s[order] != s[first])
    at = np.flatnonzero(later)
    start = np.concatenate(([True], (np.diff(at) > 1) | (row[at][1:] != row[at][:-1]))) if len(at) else np.zeros(0, bool)
    begin, end = at[start], at[np.append(np.flatnonzero(start)[1:] - 1, len(at) - 1)] if len(at) else at
    own = [batch.column(c).take(pa.array(row[begin])) for c in ("k", "t")]
    return pa.record_batch([*own, pa.array(s[begin]), pa.array(s[end] + length)], names=["k", "t", "s", "e"])


def _compared(snippets: DataFrame, length: int) -> DataFrame:
    """Later spans ``k, t, s, e`` of names with few classes, each name's compared in one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second, held, last = Rolling(SECOND), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("a").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(names)) + 1
            begin = 0
            for cut_at in cuts if last is None or names[0] == last else [0, *cuts]:
                if cut_at - begin + sum(b.num_rows for b in held) >= TOGETHER:
                    held.append(batch.slice(begin, cut_at - begin))
                    yield _later_runs(second, pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)
                    held, begin = [], cut_at
            held.append(batch.slice(begin))
            last = names[-1]
        if held:
            yield _later_runs(second, pa.Table.from_batches(held).combine_chunks().to_batches()[0], length)

    schema = f"k {snippets.schema['k'].dataType.simpleString()}, t long, s long, e long"
    return snippets.repartition("a").sortWithinPartitions("a").mapInArrow(run, schema)


def _windows(snippets: DataFrame, length: int) -> DataFrame:
    """Each window's names, key and begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = Rolling(SECOND)
        for batch in batches:
            row, s, w = _named_windows(second, batch, length)
            own = [batch.column(c).take(pa.array(row)) for c in ("k", "t", "a")]
            yield pa.record_batch([own[0], own[1], pa.array(s), own[2], pa.array(w)], names=["k", "t", "s", "a", "w"])

    return snippets.mapInArrow(run, f"k {snippets.schema['k'].dataType.simpleString()}, t long, s long, a long, w long")


def repeated_spans(docs: DataFrame, key="doc_id", text="text", length: int = LENGTH, gram: int = SEED_BYTES) -> DataFrame:
    """``k``, ``t`` and ``spans``: begin and end of repeated strings, unmerged, of each document that has some."""
    rows = small_batches(docs).select(column(key).alias("k"), F.xxhash64(utf8(text)).alias("t"), utf8(text).alias("x"))
    names = _sampled(rows, length, gram, False).groupBy("a").agg(F.count("*").alias("m")).filter("m > 1").select("a")
    names = stored(names)
    met = stored(_sampled(rows, length, gram, True).join(names, "a", "left_semi"))
    where = F.struct(F.col("k").isNotNull().alias("o"), "k", "s")
    classes = met.groupBy("a", "c").agg(F.min(F.struct(*["k", "s", "t", "n"])).alias("f"), F.max(where).alias("z"), F.min(where).alias("y"))
    classes = stored(classes.select("a", "c", "f", "y", (F.col("y") < F.col("z")).alias("more")))
    later = met.join(classes.filter("more").select("a", "c", "y"), ["a", "c"]).filter(where > F.col("y"))
    whole = later.select("k", "t", "s", (F.col("s") + F.col("n") + length - 1).alias("e"))
    mixed = classes.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1").select("a", (F.col("m") > HOT).alias("hot"))
    firsts = classes.join(mixed, "a").select("f.k", "f.t", F.struct("f.s", "f.n", "a", "hot").alias("r"))
    firsts = firsts.groupBy("k", "t").agg(F.collect_list("r").alias("runs"))
    firsts = firsts.select(F.col("k").alias("rk"), F.col("t").alias("rt"), "runs")
    texts = rows.join(firsts, F.col("k").eqNullSafe(F.col("rk")) & (F.col("t") == F.col("rt"))).select("k", "t", "runs", "x")
    # Repeated rows have the same windows at the same places, which changes nothing.
    snippets = stored(_snippets(texts, length))
    parts = _compared(snippets.filter("NOT hot"), length)
    windows = stored(_windows(snippets.filter("hot"), length))
    begun = windows.groupBy("a", "w").agg(F.min(where).alias("y"), F.max(where).alias("z")).filter("y < z").select("a", "w", "y")
    many = windows.join(begun, ["a", "w"]).filter(where > F.col("y")).select("k", "t", "s", (F.col("s") + length).alias("e"))
    parts = parts.union(many)
    spans = whole.union(parts).groupBy("k", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = stored(spans)
    return spans


def cut(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, and maximal runs removed; spans in any order."""
    spans = spans[np.argsort(spans[:, 0])]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > ends[:-1]))
    begins, ends = spans[new, 0], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]
    left, at = [], 0
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        left.append(data[at:b])
        at = e
    left.append(data[at:])
    return b"".join(left), int((ends - begins).sum()), len(begins)


def _cut_column(data: Column, spans: Column) -> Column:
    @F.pandas_udf("kept binary, n_removed long, n_spans long")
    def cutting(texts: pd.Series, lists: pd.Series) -> pd.DataFrame:
        out = []
        for x, own in zip(texts, lists, strict=True):
            found = None if own is None else np.array([(s["s"], s["e"]) for s in own], np.int64).reshape(-1, 2)
            out.append((x, 0, 0) if found is None or not len(found) else cut(x, found))
        return pd.DataFrame(out, columns=["kept", "n_removed", "n_spans"])

    return cutting(data, spans)


def dedup_substrings(docs: DataFrame, key="doc_id", text="text", length: int = LENGTH, gram: int = SEED_BYTES) -> DataFrame:
    """One row per document: ``k``, ``n_bytes``, ``kept`` (the bytes that are left), ``n_removed``, ``n_spans``."""
    spans = repeated_spans(docs, key, text, length, gram).withColumnsRenamed({"k": "rk", "t": "rt"})
    rows = docs.select(column(key).alias("k"), F.xxhash64(utf8(text)).alias("t"), utf8(text).alias("x"))
    met = rows.join(spans, F.col("k").eqNullSafe(F.col("rk")) & (F.col("t") == F.col("rt")), "left")
    met = met.select("k", "x", _cut_column(F.col("x"), F.col("spans")).alias("f"))
    return met.select("k", F.octet_length("x").cast("long").alias("n_bytes"), "f.kept", "f.n_removed", "f.n_spans")
