from __future__ import annotations

import random

import numpy as np
import pytest

from foliolens.llm import decontamination as dec
from foliolens.llm.common import table
from tests.llm.rows import no_documents, odd_documents, odd_rows


def least_edits(item, text):
    """Edit distance of the item to its nearest run of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 20))
        assert dec.best_alignment(item, text) == least_edits(item.tolist(), text.tolist())


def test_walks_keep_edit_distance():
    """Few edits leave embeddings near; other sequences are far."""
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1000, (200, 40))
    edited = items.copy()
    edited[:, 20] = 5000
    paces = rng.integers(0, 2, (120, dec.PACES), np.int8)
    steps = list(range(80))
    a, b = dec.embed(items, paces, steps), dec.embed(edited, paces, steps)
    assert (a != b).mean() < 0.25 and (a != np.roll(b, 1, axis=0)).mean() > 0.9


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_recall_and_precision_against_alignment(share):
    rng = random.Random(int(share * 100))
    vocabulary = [f"v{i}" for i in range(300)]
    draw = lambda n: rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=n)
    items = [draw(rng.randint(3, 60)) for _ in range(60)]
    texts = []
    for item in items:
        words = list(item)
        for _ in range(dec.edits_allowed(len(item)) if share == 0.2 else int(len(item) * share)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([["new"], [], [words[at], "more"]])
        texts.append(draw(40) + words + draw(40))
    texts += [draw(120) for _ in range(30)]
    found = dec.LeakFinder([" ".join(x) for x in items]).find([", ".join(t) for t in texts])
    want = [{i for i, item in enumerate(items) if least_edits(item, t) <= dec.edits_allowed(len(item))} for t in texts]
    got = [{i for i, *_ in f} for f in found]
    assert all(g <= w for g, w in zip(got, want, strict=True))
    assert sum(len(g) for g in got) >= 0.95 * sum(map(len, want))
    for own, t in zip(found, texts, strict=True):
        assert all(e >= least_edits(items[i], t) and n == len(items[i]) for i, e, n in own)


@pytest.mark.parametrize("share", [0.01, 0.1, 0.2])
@pytest.mark.parametrize("place", ["alone", "start", "end"])
def test_shortened_items(share, place):
    """Items that lost words, where a text has few or no words beside them."""
    rng = random.Random(f"{share} {place}")
    vocabulary = [f"v{i}" for i in range(300)]
    draw = lambda n: rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(300)], k=n)
    items = [draw(rng.randint(5, 60)) for _ in range(100)]
    texts = []
    for item in items:
        words = list(item)
        for _ in range(min(dec.edits_allowed(len(item)), max(1, round(len(item) * share)))):
            del words[rng.randrange(len(words))]
        texts.append(draw(40 * (place == "end")) + words + draw(40 * (place == "start")))
    found = dec.LeakFinder([" ".join(x) for x in items]).find([" ".join(t) for t in texts])
    assert sum(i in {f[0] for f in own} for i, own in enumerate(found)) >= 0.97 * len(items)
    assert all(e >= least_edits(items[i], t) for own, t in zip(found, texts, strict=True) for i, e, _ in own)


def test_given_benchmark(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    plain = [(r["item_id"], " ".join(dec.words_of(r["text"]))) for r in items.collect()]
    verbatim = {(r["doc_id"], i) for r in docs.collect() for i, x in plain if f" {x} " in f" {' '.join(dec.words_of(r['text']))} "}
    found = {(r["k"], r["item"]) for r in dec.leaks(docs, items).collect()}
    assert verbatim <= found and len(found) <= len(verbatim) + 2
    monkeypatch.setattr(dec, "ITEM_BLOCK", 7)
    assert {(r["k"], r["item"]) for r in dec.leaks(docs, items).collect()} == found
    kept = dec.drop_leaks(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({k for k, _ in found})


def test_odd_rows(spark):
    docs = odd_documents(spark)
    texts = [r[1] for r in odd_rows()]
    items = spark.createDataFrame([(1, texts[0]), (2, None), (3, ""), (4, texts[0]), (None, "one")], "item_id long, text string")
    found = dec.leaks(docs, items).collect()
    assert {r["item"] for r in found if r["k"] == 0} == {1, 4} and all(r["item"] not in (2, 3) for r in found)
    assert dec.drop_leaks(docs, items).columns == docs.columns
    assert dec.leaks(docs, items.filter("false")).count() == 0 and dec.leaks(no_documents(spark), items).count() == 0
    assert dec.drop_leaks(docs, items.filter("false")).count() == len(texts)
