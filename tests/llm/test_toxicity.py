from __future__ import annotations

import random

import pytest

from foliolens.llm.common import remainder, table
from foliolens.llm.toxicity import EDIT_LOSS, TermAutomaton, ToxicityModel, drop_toxic, edits_allowed, fit_toxicity, toxicity_score
from tests.llm.rows import no_documents, odd_documents, odd_rows


def distance(a: str, b: str) -> int:
    """Restricted Damerau-Levenshtein distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_distances():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choices("abc", k=rng.randint(2, 10))) for _ in range(12)})
    automaton = TermAutomaton(terms)
    for _ in range(3000):
        word = list(rng.choice(terms)) if rng.random() < 0.8 else rng.choices("abcd", k=rng.randint(1, 10))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randint(0, 2)] = rng.choices("abcd", k=rng.randint(0, 2))
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms]
        want = min(((d, t) for d, t in near if d <= edits_allowed(t)), default=None)
        assert automaton.match(word) == want, word


def test_quotation_and_edits():
    model = ToxicityModel({"stupid": 3.0}, around={'"': -1.5})
    plain, quoted, missed = (model.score(x) for x in ("you are Stupid today", 'they wrote "stupid" there', "so stupdi, you"))
    assert plain > 0.9 > quoted and missed < plain and model.score("$tup1d") == pytest.approx(plain, abs=0.05)
    assert model.score(None) == model.score("") == model.score("???") == 0.0
    assert EDIT_LOSS[1] > 0


def test_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    model = fit_toxicity(docs.filter(remainder("doc_id", 3) != 1), labels)
    held = docs.filter(remainder("doc_id", 3) == 1).join(labels, "doc_id")
    rows = held.select("toxic", "lang", toxicity_score(model).alias("s")).toPandas()
    en = rows[rows.lang == "en"]
    assert ((en.s >= 0.7) & (en.toxic == 0)).sum() == 0 and (en.s >= 0.7)[en.toxic == 1].mean() > 0.85
    ranks = rows.s.rank()
    n, p = (rows.toxic == 0).sum(), (rows.toxic == 1).sum()
    assert (ranks[rows.toxic == 1].sum() - p * (p + 1) / 2) / (n * p) > 0.9


def test_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    for labels in (none, nulls):
        model = fit_toxicity(docs, labels)
        kept = drop_toxic(docs, model)
        assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert drop_toxic(no_documents(spark), fit_toxicity(no_documents(spark), none)).count() == 0
