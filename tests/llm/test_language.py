from __future__ import annotations

import numpy as np

from foliolens.llm import language
from foliolens.llm.common import remainder, table
from foliolens.llm.language import BLOCK, LanguageFilter, fit_languages, grams, languages
from tests.llm.rows import no_documents, odd_documents, odd_rows


def packed(s: bytes) -> int:
    return int.from_bytes(s, "big")


def test_grams():
    assert sorted(grams(b"ab,  cde").tolist()) == sorted(packed(x) for x in (b" ab ", b" cde", b"cde "))
    assert grams(b"").size == 0 and grams(b"12 !?").size == 0


def test_filter_returns_all_languages_of_a_gram():
    """More languages than a mask word has bits; no false negatives, few false positives."""
    rng = np.random.default_rng(1)
    found = {f"l{i:03}": np.unique(rng.integers(0, 1 << 32, 300, np.uint32)) for i in range(130)}
    model = LanguageFilter.build(found)
    for i, name in enumerate(model.languages):
        assert (model.masks(found[name])[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 32, 20_000, np.uint32)
    rates = [np.mean(model.masks(other)[i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(130)]
    assert max(abs(r - f) for r, f in zip(rates, model.false, strict=True)) < 0.02


def test_counts_are_those_of_plain_sets():
    texts = {"a": b"abcd efgh ijkl", "b": b"mnop qrst uvwx abcd"}
    sets = {n: set(grams(t).tolist()) for n, t in texts.items()}
    model = LanguageFilter.build({n: np.array(sorted(s), np.uint32) for n, s in sets.items()})
    total, hits = model.counts(texts["b"])
    assert total == len(grams(texts["b"]))
    assert hits[1] == total and hits[0] >= len([g for g in grams(texts["b"]).tolist() if g in sets["a"]])
    long = b"efgh " * (BLOCK // 2)
    assert model.predict(long)[0] == "a" and model.predict(None) == ("und", 0.0)


def test_long_texts_count_like_whole_ones(monkeypatch):
    """Wherever a block ends: no n-gram is lost at its edge, none is made up."""
    text = "über den  wolken 12 ab, muß die freiheit".encode() * 3
    model = LanguageFilter.build({"a": np.unique(grams(text[:40])), "b": np.unique(grams(text[20:]))})
    total, hits = model.counts(text)
    assert total == len(grams(text))
    for block in range(1, 30):
        monkeypatch.setattr(language, "BLOCK", block)
        again = model.counts(text)
        assert again[0] == total and (again[1] == hits).all()


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    model = fit_languages(docs.filter(remainder("doc_id", 4) != 2))
    held = docs.filter(remainder("doc_id", 4) == 2)
    rows = languages(held, model).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.99
    assert rows.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    found = languages(docs, fit_languages(docs)).collect()
    assert len(found) == len(odd_rows())
    texts = [(r[0], r[1]) for r in odd_rows()]
    unknown = sum(1 for _, t in texts if not any(c.isalpha() for c in t or ""))
    assert sum(r["lang_pred"] == "und" for r in found) == unknown
    assert {r["lang_pred"] for r in languages(docs, fit_languages(no_documents(spark))).collect()} == {"und"}
    assert languages(no_documents(spark), fit_languages(docs)).count() == 0
