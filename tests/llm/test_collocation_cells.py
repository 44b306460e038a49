from __future__ import annotations

import random
import re

from foliolens.llm import collocations as mining

WORDS = [f"w{i}" for i in range(60)]


def documents(spark):
    """Frequent words in pairs that mostly aren't, and one phrase that is."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(80)) + ". one two three four", "en") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_only_what_may_be_frequent_is_counted_as_phrases(spark, monkeypatch):
    """Of pairs and longer phrases few but the frequent ones are rows."""
    sent, counted = [], mining.counted

    def spied(docs, low, *more, **how):
        rows = counted(docs, low, *more, **how)
        if low > 1:
            sent.append(rows.count())
        return rows

    monkeypatch.setattr(mining, "counted", spied)
    found, _ = mining.phrase_counts(documents(spark), least=40)
    longer = {r["phrase"]: r["n"] for r in found.collect() if " " in r["phrase"]}
    assert longer == {p: 80 for p in ("one two", "two three", "three four", "one two three", "two three four", "one two three four")}
    assert sum(sent) < 20


def test_words_of_all_lengths_have_their_own_ids():
    rng = random.Random(7)
    words = [b"a", b"a\0", b"\0", b"a\0\0", "é".encode(), b"\x1c", *[bytes(rng.choices(b"xyz", k=n)) for n in (6, 7, 8, 9, 16, 70) for _ in range(9)]]
    data = b"".join(rng.choice(words) + rng.choice([b" ", b"  ", b"\t", b". ", b"\n"]) for _ in range(5000))
    ids = mining.WordIds(b"en", None)
    got = [ids.words[i] if i else mining.END for i in ids.of(data).tolist()]
    pieces = [re.findall(rb"[^ \t]+", p) for p in re.split(rb"[.,;:!?\n\x0b\x0c\r]", data)]
    assert got == [w for p in pieces for w in [*p, mining.END]]
