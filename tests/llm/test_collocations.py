from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliolens.llm import collocations as mining
from foliolens.llm.common import table
from foliolens.llm.queries import QUERIES
from tests.llm.rows import no_documents, odd_documents, odd_rows
from tests.oracle import compare, connect


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, top):
    """``rows`` of (text, lang): what the contract says, with Python's numbers."""
    counts, sizes = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            sizes[lang or "und"] += len(words)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(1000 * a * sizes[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= 100 * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, rest) in enumerate(sorted(found)[:top], 1):
            result.append((lang, rank, p.decode(), -a, left, rest, sizes[lang], -score))
    return sorted(result)


@pytest.mark.parametrize("entries,burst", [(1 << 20, 4096), (60, 3)])
def test_against_brute_force(spark, entries, burst):
    """Also with tries that burst and spill all the time."""
    rng = random.Random(3)
    words = ["the", "of", "New York City", "grand New York City hall", "é", "\xa0x", "a-b", "und"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["  ", " ", " ", " ", "\t", ". ", "\n"]) for _ in range(60)), rng.choice(["en", "fr", None]), "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = mining.collocations(docs, least=20, top=50, bits=1 << 12, entries=entries, burst=burst).collect()
    assert sorted(map(tuple, found)) == brute([r[1:3] for r in rows], 20, 50)
    assert any(len(r["phrase"].split(" ")) > 2 for r in found)


def test_odd_rows(spark):
    want = brute([r[1:3] for r in odd_rows()], 5, 2000)
    found = mining.collocations(odd_documents(spark), least=5).collect()
    assert sorted(map(tuple, found)) == want and want
    assert mining.collocations(no_documents(spark)).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    run, sql = QUERIES["op13_collocations"]
    assert compare(run(spark, folder), connect(folder), sql) is None


def test_trie_bursts_and_spills():
    rng, trie, want = random.Random(1), mining.HatTrie(burst=4), Counter()
    for _ in range(5000):
        ids = tuple(rng.randrange(1, 7) for _ in range(rng.randint(1, 5)))
        trie.add(ids)
        want[ids] += 1
    assert trie.entries == len(want) and any(type(x) is mining.Node for x in trie.root.values())
    sizes = trie.subtrees()
    for first in list(trie.root):
        run = trie.spill(first)
        assert len(run) == sizes[first] and dict(run) == {ids: n for ids, n in want.items() if ids[0] == first}
    assert trie.entries == 0


def test_bitmap_agrees_with_spark(spark):
    rows = [(f"l{i % 3}", f"wört{i} x") for i in range(500)]
    marked = mining.bitmap(spark.createDataFrame(rows, "lang string, phrase string"), 1 << 14)
    assert all(f"{a} {b}".encode() in marked for a, b in rows)
    assert sum(f"l0 other{i}".encode() in marked for i in range(1000)) < 100


def test_only_named_columns_are_read(spark):
    body = table(spark, "/root/testdata/sf0.001", "documents").select("lang", F.encode("text", "utf-8").alias("x"))
    assert "source" not in mining.counted(body, 1, 1, None)._jdf.queryExecution().executedPlan().toString()
