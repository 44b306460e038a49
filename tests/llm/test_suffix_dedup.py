from __future__ import annotations

import random

import numpy as np
import pytest

from foliolens.llm import suffix_dedup
from foliolens.llm.suffix_dedup import Rolling, cut, dedup_substrings
from tests.llm.rows import no_documents, odd_documents, odd_rows

DOCS = "doc_id long, text string"


def brute(rows, length=100):
    """(bytes, removed, spans, what is left) by key and text, from every string of the length."""
    first: dict[bytes, tuple] = {}
    order = sorted({(k is not None, k or 0, t or "") for k, t in rows})
    for o, k, t in order:
        data = t.encode()
        for i in range(len(data) - length + 1):
            first[data[i : i + length]] = min(first.get(data[i : i + length], (o, k, i)), (o, k, i))
    result = {}
    for o, k, t in order:
        data = t.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (o, k, i):
                gone[i : i + length] = b"\1" * length
        left = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        result[(k if o else None), len(data), left] = (len(data), sum(gone), spans)
    return result


def check(spark, rows):
    found = dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == want[r["k"], r["n_bytes"], bytes(r["kept"])]


def passages(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    make = lambda m: "".join(rng.choices(letters, k=m))
    shared = [make(rng.randint(80, 260)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else make(rng.randint(0, 150)) for _ in range(4)]
        rows.append((i, "".join(parts)))
    rows += [(n, "ab" * 400), (n + 1, "a" * 350), (n + 2, "b" + "a" * 120), (n + 3, "ab" * 400), (n + 4, None), (n + 5, "")]
    return [*rows, rows[5], rows[5], (None, rows[7][1]), (3, rows[9][1])]


@pytest.mark.parametrize("hot", [4096, 1])
def test_against_every_string(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 8)
    check(spark, passages(hot))


def test_texts_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    check(spark, passages(5, 30))


def test_odd_rows(spark):
    found = dedup_substrings(odd_documents(spark))
    assert found.count() == len(odd_rows())
    assert dedup_substrings(no_documents(spark)).count() == 0


def test_hashes_depend_on_content_alone():
    data = np.frombuffer(b"x" * 10 + b"hello world" + b"y" * 7 + b"hello world", np.uint8)
    rolling = Rolling(1)
    names = rolling.of(rolling.sums(data), np.array([10, 28, 11]), np.array([21, 39, 22]))
    assert names[0] == names[1] != names[2]


def test_cut():
    spans = np.array([[5, 7], [0, 2], [6, 9], [9, 10]])
    assert cut(b"0123456789ab", spans) == (b"234ab", 7, 2)
