"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["score", "shard", "curve", "k", "t", "x", "spans", "found", "taken", "f", "group_k", "kept_text"]


def words(rng: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def odd_rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(5, 120)), rng.choice(["en", "fr"]), rng.choice(["a", "b", "é"]), i) for i in range(n)]
    base = words(rng, 90)
    rows += [(n + i, base, "en", "a", 1) for i in range(6)]
    rows += [(n + 10, base + " tail", None, None, None), (n + 11, None, None, "b", None), (n + 12, "", "en", None, 0)]
    rows += [(n + 13, " \n\t ", "fr", "a", 4), (n + 14, "é" * 150 + "\n" + base, "fr", "b", 2), (n + 15, "one", "en", "b", 3)]
    rows += [rows[3], rows[3], (None, words(rng, 30), "en", "a", 5), (n + 16, words(rng, 30_000, 5000), "en", "a", 6)]
    return rows


def odd_documents(spark, clashing: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit(c).alias(c) for c in CLASHES]) if clashing else df


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
