from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from foliolens.llm.simhash import ball_masks, components, drop_near_copies, fingerprint, near_links, simhash_groups
from tests.llm.rows import no_documents, odd_documents, odd_rows


def plain_fingerprint(text: str) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(prints: list[int], radius: int = 2) -> list[int]:
    """Smallest number of each fingerprint's component, by all pairs."""
    own = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= radius and own[i] != own[j]:
                old, new = max(own[i], own[j]), min(own[i], own[j])
                own = [new if x == old else x for x in own]
    return own


def test_fingerprint():
    rng = random.Random(2)
    texts = ["", " \n", "One", "one two", "A b C d", "É é x y", *[" ".join(rng.choices(["a", "B", "c\x0b", " d"], k=50)) for _ in range(20)]]
    for text in texts:
        assert fingerprint(text.encode()) & (1 << 64) - 1 == plain_fingerprint(text)


def test_groups_against_all_pairs(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(120):
        near = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(1, 3)):
            near ^= 1 << b
        prints.append(near)
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = near_links(spark.createDataFrame([(p,) for p in signed], "f long"))
    roots = {r["v"]: r["u"] for r in components(links).collect()}
    want = classes(prints)
    for i, p in enumerate(signed):
        for j in range(i):
            assert (roots.get(p, p) == roots.get(signed[j], signed[j])) == (want[i] == want[j])


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    assert {(r["u"], r["v"]) for r in components(links).collect()} == {(0, i) for i in range(1, 301)}


def test_radius():
    assert len(ball_masks(2)) == 65 and len(ball_masks(0)) == 1
    with pytest.raises(ValueError):
        ball_masks(3)


def test_odd_rows(spark):
    rows = odd_rows()
    found = simhash_groups(odd_documents(spark)).collect()
    assert len(found) == len(rows)
    texts = sorted({(r[1] or "") for r in rows})
    prints = {t: plain_fingerprint(t) for t in texts}
    distinct = sorted(set(prints.values()))
    own = dict(zip(distinct, classes(distinct), strict=True))
    least: dict[int, int] = {}
    for key, text, *_ in rows:
        c = own[prints[text or ""]]
        if key is not None:
            least[c] = min(least.get(c, key), key)
    want = sorted((str(k), least.get(own[prints[t or ""]])) for k, t, *_ in rows)
    assert sorted((str(r["k"]), r["component"]) for r in found) == want
    kept = drop_near_copies(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns and kept.count() == len(set(own[p] for p in prints.values()))
    assert kept.filter(F.col("doc_id").isNull()).count() == 1
    assert simhash_groups(no_documents(spark)).count() == 0 and drop_near_copies(no_documents(spark)).count() == 0
