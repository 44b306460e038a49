"""SimHash near-dedup by meeting in the middle.

Two fingerprints that differ in at most ``radius`` bits (an even number) have a
common variant within half of it. Every distinct fingerprint emits all variants
within half the radius; those that meet on a variant differ in at most
``radius`` bits. Each links to its neighbour in the sorted bucket, which keeps
the bucket connected without all its pairs; a bucket holds distinct fingerprints
of one ball only (65 at radius 2), however many copies a text has.

Components come from alternating large-star and small-star steps over these
links, each step stored in the shared folder, so no links reach the driver.

Edge cases: null and empty texts, and texts of white space, have fingerprint
zero and link like any other. Texts of fewer words than a shingle are one
shingle. Null keys take part; the smallest key ignores them, so a component of
null keys alone has a null id. Repeated rows all get their row in the result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, fresh, small_batches, stored, utf8

WORDS, SEED, RADIUS = 3, 42, 2
#: Shingles whose bits are counted at once.
BLOCK = 1 << 14


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the UTF-8 text: a bit is 1 if over half the shingles' hashes have it."""
    tokens = data.lower().split()  # of bytes: only A-Z change, only ASCII white space separates
    if not tokens:
        return 0
    width = min(words, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, len(tokens) - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_column(text: str, words: int = WORDS, seed: int = SEED):
    @F.pandas_udf("long")
    def prints(data: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, words, seed) for x in data], dtype="int64")

    return prints(utf8(text))


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most half the radius of bits, as signed numbers."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: only then do all that meet on a variant lie within it")
    masks = [sum(1 << b for b in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``u < v`` between distinct fingerprints ``f`` that connect all within the radius."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(radius)])
    variants = prints.select("f", F.explode(masks).alias("m")).select("f", F.col("f").bitwiseXOR(F.col("m")).alias("v"))
    bucket = Window.partitionBy("v").orderBy("f")
    met = variants.select("f", F.lag("f").over(bucket).alias("u")).filter("u IS NOT NULL")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("f"))) <= radius
    return met.filter(close).select("u", F.col("f").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    met = links.join(least, "v")
    pairs = met.select(F.col("m").alias("u"), F.col("u").alias("v")).union(met.select(F.col("m").alias("u"), "v"))
    return pairs.filter("u < v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Of links ``u < v``: each node ``v`` that isn't its component's least, with the least as ``u``."""
    links, before = stored(links), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return links
        before, links = now, stored(_small_star(_large_star(links)))


def simhash_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """One row per document: ``k`` (key), ``t`` (hash of the text), ``f`` (fingerprint
    as a signed number), ``root`` (least fingerprint of the component),
    ``component`` (least key of all reachable documents)."""
    rows = small_batches(docs).select(
        column(key).alias("k"), F.xxhash64(column(text)).alias("t"), fingerprint_column(text, words, seed).alias("f")
    )
    rows = stored(rows)
    prints = rows.groupBy("f").agg(F.min("k").alias("least"))
    roots = components(near_links(prints.select("f"), radius)).select(F.col("v").alias("f"), F.col("u").alias("root"))
    rooted = prints.join(roots, "f", "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(rooted.join(least, "root").select("f", "root", "component"), "f").select("k", "t", "f", "root", "component")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, the one with the least key, with all its columns.

    Of rows that share this key, the one whose text has the least hash stays, once.
    """
    return keep_least(docs, simhash_groups(docs, key, text, **how), key, text)


def keep_least(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """The document with the least key of each component of ``groups`` (``k``, ``t``, ``root``, ``component``)."""
    k, t = fresh(docs, "group_k", "group_t")
    least = groups.filter(F.col("k").eqNullSafe(F.col("component")))
    kept = least.groupBy("root").agg(F.min(F.struct("k", "t")).alias("r")).select(F.col("r.k").alias(k), F.col("r.t").alias(t))
    body = F.xxhash64(column(text))
    met = docs.join(kept, column(key).eqNullSafe(column(k)) & (body == column(t)))
    return met.dropDuplicates([k, t]).select(*[column(c) for c in docs.columns])
