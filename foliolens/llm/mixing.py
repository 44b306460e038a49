"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source gets a target number of words (see ``targets``). Whole rounds of a
source are taken first; what remains is its quota, drawn without replacement:

* every document belongs to one of 2^depth output shards by the hash of its key,
  and a source's words in a shard are its block there;
* the tree splits a source's quota at each node between the left and the right
  half of the shards by a hypergeometric draw over the words below them, so the
  shares of all shards follow the multivariate hypergeometric law and add up to
  the quota exactly;
* each shard permutes its documents of the source by a keyed hash and takes them
  in this order until its share is met, the last one in part.

Draws depend on the seed, the source and the node only: reruns agree. The depth
follows the number of documents, so that what is sorted together stays about
``leaf_rows`` rows however hot the source. The tree runs as grouped steps of ten
levels each; a group is a node with its 1024 grandchildren at most.

Edge cases: null and empty texts have size 0, their documents are taken with 0
words. The null source is one source, the last. Repeated rows count each on its
own. Empty tables give empty results. Extra columns are carried by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, fresh, stored

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), (3, 2), 2, 17
LEAF_ROWS, LEVELS = 4096, 10
WORD = r"[^\x20\x09-\x0D]+"
#: numpy draws from populations below this; above, ``_large_draw`` does, by the same law.
NUMPY_LIMIT = 10**9


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """Adds ``target`` and ``quota`` (its nearest whole number) to ``source, source_size``.

    Sources in the order of their code points, null last, weigh ``weights`` in
    turn and share ``share`` of all words by weight; a target stops at ``cap``
    times the source and the excess goes to the others by weight. Sorted by
    cap per weight, the capped sources come first, so running sums decide.
    All is exact up to the last division. The table has one row per source.
    """
    num, den = share
    exact = lambda name: F.col(name).cast("decimal(38,0)")
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("w", weigh)
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    summed = (
        weighed.withColumn("all_s", F.sum(exact("source_size")).over(Window.partitionBy()))
        .withColumn("all_w", F.sum(exact("w")).over(Window.partitionBy()))
        .withColumn("s0", F.coalesce(F.sum(exact("source_size")).over(before), F.lit(0)))
        .withColumn("w0", F.coalesce(F.sum(exact("w")).over(before), F.lit(0)))
    )
    # In units of 1/den words: what is left for the sources from here on, and their weights.
    left = (F.col("all_s") * num - F.col("s0") * cap * den).cast("decimal(38,0)")
    over = exact("source_size") * cap * den * (F.col("all_w") - F.col("w0")) <= left * exact("w")
    free = summed.withColumn("left", left).withColumn("over", over)
    first = F.min(F.when(~F.col("over"), F.struct(F.col("s0"), F.col("w0"), "left", "all_w"))).over(Window.partitionBy())
    shared = F.col("w").cast("double") * F.col("f.left").cast("double")
    target = F.when(F.col("over"), (F.col("source_size") * cap).cast("double")).otherwise(
        shared / (den * (F.col("f.all_w") - F.col("f.w0"))).cast("double")
    )
    return free.withColumn("f", first).withColumn("target", target).select(
        "source", "source_size", "target", F.round("target").cast("long").alias("quota")
    )


def _log_factorials(x: int, y: int) -> float:
    """ln(x! / y!), by the difference of Stirling's series, so that large numbers don't cancel."""
    if min(x, y) < 1000:
        return math.lgamma(x + 1) - math.lgamma(y + 1)
    step = x - y
    series = [1 / (12 * z) - 1 / (360 * z**3) for z in (float(x), float(y))]
    return (y + 0.5) * math.log1p(step / y) - step + step * math.log(x) + series[0] - series[1]


def _large_draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """A hypergeometric draw by the ratio of uniforms, for populations of any size.

    A proposal is accepted by its probability relative to the mode's, so that the
    law is the hypergeometric one and not a limit of it. The hat's constants are
    those for laws with a log-concave mass.
    """
    all_, low, high = good + bad, max(0, taken - bad), min(good, taken)
    mean = taken * good / all_
    spread = mean * (bad / all_) * ((all_ - taken) / (all_ - 1))
    width = 2 * math.sqrt(2 / math.e) * math.sqrt(spread + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    mode = (good + 1) * (taken + 1) // (all_ + 2)
    while True:
        u, v = 1 - rng.random(), rng.random()
        n = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= n <= high:
            parts = ((mode, n), (good - mode, good - n), (taken - mode, taken - n), (bad - taken + mode, bad - taken + n))
            if 2 * math.log(u) <= sum(_log_factorials(x, y) for x, y in parts):
                return n


def _draw(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """How many of ``taken`` words drawn from ``good + bad`` are good."""
    low, high = max(0, taken - bad), min(good, taken)
    if low == high:
        return low
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, taken))
    return _large_draw(rng, good, bad, taken)


def split_quota(words: list[int], quota: int, label: str, seed: int = SEED) -> list[int]:
    """Shares of the quota by repeated halving; they add up to it and none exceeds its words."""
    if len(words) == 1:
        return [quota]
    half = 1 << ((len(words) - 1).bit_length() - 1)
    left, right = sum(words[:half]), sum(words[half:])
    rng = np.random.Generator(np.random.Philox(xxhash.xxh64_intdigest(label, seed=seed)))
    n = _draw(rng, left, right, quota)
    return split_quota(words[:half], n, label + "0", seed) + split_quota(words[half:], quota - n, label + "1", seed)


def _tree_step(blocks: DataFrame, above: DataFrame, seed: int) -> DataFrame:
    """Shares ``q`` of the nodes ``source, node, child, words`` below ``source, node, q``."""

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(1 << LEVELS, dtype=object)
        words[pdf["child"]] = [int(w) for w in pdf["words"]]
        source = pdf["source"].iloc[0]
        label = f"{'-' if source is None else '+' + source}/{pdf['node'].iloc[0]}/"
        shares = split_quota(list(words), int(pdf["q"].iloc[0]), label, seed)
        return pdf[["source"]].assign(node=pdf["node"] * (1 << LEVELS) + pdf["child"], q=[shares[c] for c in pdf["child"]])

    met = blocks.withColumnRenamed("source", "s").withColumnRenamed("node", "n")
    met = met.join(above, F.col("source").eqNullSafe(F.col("s")) & (F.col("node") == F.col("n")))
    return met.select("source", "node", "child", "words", "q").groupBy("source", "node").applyInPandas(
        split, "source string, node long, q long"
    )


def mix_sizes(
    docs: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """One row per document: ``k``, ``t`` (hash of the text), ``source``, ``size``,
    ``source_size``, ``target``, ``taken`` (words the mix takes, repeats counted),
    ``shard`` and ``place`` (order within shard and source)."""
    rows = docs.select(
        column(key).alias("k"),
        F.xxhash64(column(text)).alias("t"),
        column(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(column(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(column(key), column(text), F.lit(seed)).alias("h"),
    )
    rows = stored(rows)
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    n = sums.agg(F.sum("n")).first()[0] or 0
    depth = max(1, math.ceil(math.log2(max(2, n / leaf_rows))))
    steps = math.ceil(depth / LEVELS)
    goals = targets(sums.select("source", "source_size"), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0)
    goals = stored(goals.withColumn("rounds", whole.cast("long")))
    # A shard's number has its first bits in the first step, and zeros below the depth.
    spread = F.shiftleft(F.shiftrightunsigned("h", 64 - depth), steps * LEVELS - depth)
    rows = rows.withColumn("node", spread)
    leaves = rows.groupBy("source", "node").agg(F.sum("size").alias("words"))
    quotas = goals.select("source", F.lit(0).cast("long").alias("node"), (F.col("quota") - F.col("rounds") * F.col("source_size")).alias("q"))
    for step in range(1, steps + 1):
        at = (steps - step) * LEVELS
        here = leaves.select("source", F.shiftright("node", at).alias("c"), "words").groupBy("source", "c").agg(F.sum("words").alias("words"))
        here = here.select("source", F.shiftright("c", LEVELS).alias("node"), (F.col("c") % (1 << LEVELS)).cast("int").alias("child"), "words")
        quotas = _tree_step(here, quotas, seed)
    quotas = stored(quotas).select(F.col("source").alias("qs"), F.col("node").alias("qn"), "q")
    goals = goals.select(F.col("source").alias("gs"), "source_size", "target", "rounds")
    met = rows.join(quotas, F.col("source").eqNullSafe(F.col("qs")) & (F.col("node") == F.col("qn")))
    order = Window.partitionBy("source", "node").orderBy("h", "k", "t")
    met = met.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "place", F.row_number().over(order)
    )
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("q") - F.col("upto") + F.col("size")))
    return met.join(goals, F.col("source").eqNullSafe(F.col("gs"))).select(
        "k", "t", "source", "size", "source_size", "target",
        (F.col("rounds") * F.col("size") + extra).cast("long").alias("taken"), F.col("node").alias("shard"), "place",
    )


def mix(docs: DataFrame, key="doc_id", text="text", source="source", **how) -> DataFrame:
    """The mixed documents with all their columns: a row for each whole time they are taken.

    What is left of a document's words below a whole time is the chance of one more
    row, by a draw that its key, its text and the seed fix: texts are never cut, and
    a source's words are those of its target but for one document of each shard.
    Documents of which nothing is taken are left out. Repeated rows (same key and
    text) share what they take; the columns of one of them stand for all.
    """
    k, t, times, nth = fresh(docs, "mix_k", "mix_t", "mix_times", "mix_round")
    found = mix_sizes(docs, key, text, source, **how).filter("taken > 0")
    shares = found.groupBy("k", "t", "size").agg(F.sum("taken").alias("taken"))
    chance = F.xxhash64("k", "t", F.lit(how.get("seed", SEED) + 1)) / F.lit(2.0**64) + 0.5
    more = (chance < F.col("taken") % F.col("size") / F.col("size")).cast("int")
    shares = shares.select(
        F.col("k").alias(k), F.col("t").alias(t), (F.floor(F.col("taken") / F.col("size")).cast("int") + more).alias(times)
    ).filter(column(times) > 0)
    met = docs.join(shares, column(key).eqNullSafe(column(k)) & (F.xxhash64(column(text)) == column(t)))
    met = met.dropDuplicates([k, t]).withColumn(nth, F.explode(F.sequence(F.lit(1), column(times))))
    return met.select(*[column(c) for c in docs.columns])
