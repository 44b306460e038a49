from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from foliolens.llm import mixing
from foliolens.llm.common import table
from tests.llm.rows import no_documents, odd_documents, odd_rows


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes: dict):
    """Shares by weight; those above twice their size stop there and the excess is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(2 * sizes[s] for s in stopped)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: Fraction(2 * sizes[s]) for s in stopped}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        stopped.update(over)


def check(rows, found):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    goals = brute_targets(sizes)
    assert len(found) == len(rows)
    assert sorted((str(r["k"]), r["size"]) for r in found) == sorted((str(r[0]), size_of(r[1])) for r in rows)
    taken = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(float(goals[r["source"]]))
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= 0.5


@pytest.mark.parametrize("leaf_rows", [4096, 4])
def test_targets_and_quotas(spark, leaf_rows):
    rows = odd_rows()
    found = mixing.mix_sizes(odd_documents(spark), leaf_rows=leaf_rows).collect()
    check(rows, found)
    again = mixing.mix_sizes(odd_documents(spark).repartition(7), leaf_rows=leaf_rows).collect()
    key = lambda r: (str(r["k"]), r["t"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_deep_tree(spark, monkeypatch):
    """More levels than one grouped step has."""
    monkeypatch.setattr(mixing, "LEVELS", 2)
    rows = [(i, "w " * (i % 9), "en", f"s{i % 4}", 1) for i in range(500)]
    found = mixing.mix_sizes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), leaf_rows=8).collect()
    check(rows, found)
    assert len({r["shard"] for r in found}) > 20


def test_mixed_texts(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    wanted = {r["k"]: r for r in mixing.mix_sizes(docs).collect()}
    whole = {r["doc_id"]: r for r in docs.collect()}
    rows = mixed.collect()
    assert all(r == whole[r["doc_id"]] for r in rows)  # no text is cut
    times = Counter(r["doc_id"] for r in rows)
    for k, r in wanted.items():
        least, rest = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        assert least <= times[k] <= least + (rest > 0)
    again = Counter(r["doc_id"] for r in mixing.mix(docs.repartition(5)).collect())
    assert again == times
    assert mixing.mix(no_documents(spark)).count() == 0 and mixing.mix_sizes(no_documents(spark)).count() == 0
    odd = mixing.mix(odd_documents(spark))
    assert odd.columns == odd_documents(spark).columns and odd.count() > 0


def test_draws_add_up():
    words = [5, 0, 100, 3, 10**12, 7, 0, 1]
    for quota in (0, 1, 50, 10**11, sum(words)):
        shares = mixing.split_quota(words, quota, "x/")
        assert sum(shares) == quota and all(0 <= s <= w for s, w in zip(shares, words, strict=True))
        assert shares == mixing.split_quota(words, quota, "x/")


@pytest.mark.parametrize(("good", "bad", "taken"), [(300, 500, 200), (40_000, 9_000, 3_000), (7, 10**6, 500_000)])
def test_large_draws_follow_the_law(good, bad, taken):
    """The draws of large populations, tried on small ones: chi squared against the exact masses."""
    rng, tries = np.random.default_rng(5), 40_000
    drawn = Counter(mixing._large_draw(rng, good, bad, taken) for _ in range(tries))
    ln = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mass = {k: math.exp(ln(good, k) + ln(bad, taken - k) - ln(good + bad, taken)) for k in range(max(0, taken - bad), min(good, taken) + 1)}
    often = [k for k, m in mass.items() if m * tries >= 10]
    chi = sum((drawn[k] - mass[k] * tries) ** 2 / (mass[k] * tries) for k in often)
    assert chi < len(often) + 5 * math.sqrt(2 * len(often))
    assert set(drawn) <= set(mass)


def test_large_draws_of_large_populations():
    """Mean and spread where numpy has no draw."""
    good, bad, taken, tries = 4 * 10**13, 6 * 10**13, 10**13, 4000
    rng = np.random.default_rng(6)
    found = np.array([mixing._draw(rng, good, bad, taken) - taken * 4 // 10 for _ in range(tries)], float)
    spread = math.sqrt(taken * 0.24 * 0.9)
    assert abs(found.mean()) < 5 * spread / math.sqrt(tries) and abs(found.std() / spread - 1) < 0.06
