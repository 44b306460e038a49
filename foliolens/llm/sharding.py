"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its quantiles (``2^bits`` steps, a bounded list):
approximate ones of numbers, exact ones of strings, which are counted and compared
by their whole values. The quantised point becomes its index on the Hilbert curve,
rows are put in this order and the order is cut into runs. Rows near on the curve are
near in all dimensions, so the ranges of each run are narrow in all of them and
readers can skip files by any of them.

Law ``bytes``: cuts fall where the sizes are equal; ``rows``: where the counts
are. Rows of equal text share the point of their first row (least key) and stand
together; a cut that would part them moves to their nearer edge if that is
within ``give`` of a shard's size, else the law goes first and they are parted.

Only DataFrame functions are used. Positions come from a range shuffle: sums per
sorted partition (one row each) become offsets, running sums stay inside a
partition. Ties on the curve are ordered by text hash and key, so a point that
holds a third of all rows still spreads over many partitions.

Edge cases: null values of a dimension are its first step; null and empty texts
count 1 byte; repeated rows are placed each; null keys sort first; empty tables
give empty results. Extra columns are no input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from foliolens.llm.common import column, fresh, stored

SHARDS, BITS, GIVE = 16, 5, 0.05
DIMENSIONS = ("source", "lang", "n_chars")


def _curve_steps(n: int) -> tuple[list[int], list[int]]:
    """Of each state and orthant: the digit on the curve and the next state.

    A state is an entry corner and a direction; the rule is Hamilton's, from
    Gray codes and rotations of n-bit corners.
    """
    full = (1 << n) - 1
    turn = lambda x, by: (x << by % n | x >> (n - by % n)) & full
    gray = lambda i: i ^ i >> 1
    place = {gray(i): i for i in range(1 << n)}
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    way = lambda w: 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
    digits, states = [], []
    for state in range(n << n):
        corner, axis = state & full, state >> n
        for orthant in range(1 << n):
            w = place[turn(orthant ^ corner, n - (axis + 1) % n)]
            digits.append(w)
            states.append((axis + way(w) + 1) % n << n | corner ^ turn(entry(w), axis + 1))
    return digits, states


def hilbert_index(codes: list[Column], bits: int = BITS) -> Column:
    """Index on the curve of a point of small whole numbers, as a long."""
    n = len(codes)
    digits, states = (F.array(*map(F.lit, x)) for x in _curve_steps(n))

    def step(at: Column, level: Column) -> Column:
        orthant = F.lit(0)
        for axis, code in enumerate(codes):
            bit = F.floor(code / F.pow(F.lit(2), level)).cast("int") % 2
            orthant = orthant + bit * (1 << axis)
        turn = at["s"] * (1 << n) + orthant + 1
        digit = F.element_at(digits, turn.cast("int")).cast("long")
        return F.struct((at["h"] * (1 << n) + digit).alias("h"), F.element_at(states, turn.cast("int")).alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step, lambda at: at["h"])


def _ordered(df: DataFrame, name: str) -> Column:
    """The value as a number or a string, which is in the same order."""
    return column(name).cast("double" if _is_number(df, name) else "string")


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def _string_edges(rows: DataFrame, names: list[str], cuts: list[float]) -> dict[str, list[str]]:
    """Of each string column: the whole values at which these shares of its rows are reached.

    Equal values are counted before the range shuffle; at most one value for each cut is collected.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), column(d).alias("x")) for i, d in enumerate(names)]))
    values = rows.select(pairs.alias("p")).select("p.i", "p.x").filter("x IS NOT NULL").groupBy("i", "x").agg(F.count("*").alias("n"))
    ranged = stored(values.repartitionByRange("i", "x").withColumn("part", F.spark_partition_id()))
    totals = {r["i"]: r["n"] for r in ranged.groupBy("i").agg(F.sum("n").alias("n")).collect()}
    sums = ranged.groupBy("part").agg(F.sum("n").alias("w"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    inside = Window.partitionBy("part").orderBy("i", "x").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("upto", F.sum("n").over(inside)).join(sums, "part").withColumn("upto", F.col("w0") + F.col("upto"))
    reached, start = F.lit(False), 0
    for i in range(len(names)):
        for c in cuts:
            at = F.lit(start + c * totals.get(i, 0))
            reached |= (F.col("i") == i) & (F.col("upto") - F.col("n") < at) & (at <= F.col("upto"))
        start += totals.get(i, 0)
    found = upto.filter(reached).select("i", "x").collect()
    return {d: [r["x"] for r in found if r["i"] == i] for i, d in enumerate(names)}


def curve_rows(docs: DataFrame, key="doc_id", text="text", dimensions=DIMENSIONS, bits: int = BITS) -> DataFrame:
    """``k``, ``t`` (hash of the text), ``size``, ``text_crc32``, ``copies`` and
    ``curve`` of each row; equal texts have the curve index of their first row."""
    body = F.encode(F.coalesce(column(text).cast("string"), F.lit("")), "UTF-8")
    rows = docs.select(
        column(key).alias("k"),
        F.xxhash64(body).alias("t"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *[_ordered(docs, d).alias(f"d{i}") for i, d in enumerate(dimensions)],
    )
    rows = stored(rows)
    point = [f"d{i}" for i in range(len(dimensions))]
    cuts = [i / (1 << bits) for i in range(1, 1 << bits)]
    numbers = [p for p, d in zip(point, dimensions, strict=True) if _is_number(docs, d)]
    strings = [p for p in point if p not in numbers]
    edges = rows.agg(*[F.percentile_approx(d, cuts, 10_000).alias(d) for d in numbers]).first().asDict() if numbers else {}
    if strings:
        edges |= _string_edges(rows, strings, cuts)
    texts = rows.groupBy("t", "size", "text_crc32").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("k").isNotNull(), "k", *point)).alias("p")
    )

    def code(d: str) -> Column:
        steps = sorted(set(edges[d] or []))
        above = [F.when(F.col(f"p.{d}") > F.lit(e), 1).otherwise(0) for e in steps]
        return F.coalesce(sum(above, F.lit(0)), F.lit(0)).cast("int")

    texts = texts.select("t", "size", "text_crc32", "copies", *[code(d).alias(d) for d in point])
    texts = texts.select("t", "size", "text_crc32", "copies", hilbert_index([F.col(d) for d in point], bits).alias("curve"))
    return rows.select("k", "t", "size", "text_crc32").join(texts, ["t", "size", "text_crc32"])


def place(rows: DataFrame, shards: int = SHARDS, law: str = "bytes", give: float = GIVE) -> DataFrame:
    """Adds ``shard`` and ``slot`` (gapless from 0) to rows of ``curve_rows``."""
    order = ["curve", "t", "size", "text_crc32", "k"]
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()))
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    sums = ranged.groupBy("part").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("w", "n")])
    inside = Window.partitionBy("part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    running = ranged.withColumn("w", weight)
    running = running.withColumn("upto", F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn("nth", F.row_number().over(inside)).join(sums, "part")
    at = stored(running.withColumn("at", F.col("w0") + F.col("upto") - F.col("w")).withColumn("row", F.col("n0") + F.col("nth") - 1).drop("part", "upto", "nth", "w0", "n0"))
    total = at.agg(F.sum("w")).first()[0] or 0
    cuts = _cuts(at, total, shards, law, give)
    shard = sum([F.when(F.col("at") >= F.lit(c), 1).otherwise(0) for c in cuts], F.lit(0)).cast("int")
    placed = at.withColumn("shard", shard)
    begins = placed.groupBy("shard").agg(F.min("row").alias("begin"))
    return placed.join(begins, "shard").withColumn("slot", F.col("row") - F.col("begin")).drop("at", "w", "row", "begin")


def _cuts(at: DataFrame, total: int, shards: int, law: str, give: float) -> list[int]:
    """Where shards begin, at rows' edges: one number for each cut."""
    even = [-(-total * i // shards) for i in range(1, shards)]
    if law == "rows" or not total:
        return even
    # The rows that a cut falls into, one for each: their nearer edge, or that of their copies.
    hit = F.greatest(*[F.when((F.col("at") <= c) & (c < F.col("at") + F.col("w")), c) for c in even], F.lit(None).cast("long"))
    across = at.withColumn("cut", hit).filter("cut IS NOT NULL").select("cut", "t", "size", "text_crc32", "at", "w", "copies")
    found = {r["cut"]: r for r in across.limit(shards).collect()}
    groups = {(r["t"], r["size"], r["text_crc32"]) for r in found.values() if r["copies"] > 1}
    spans = {}
    if groups:
        of = [(F.col("t") == t) & (F.col("size") == s) & (F.col("text_crc32") == c) for t, s, c in groups]
        same = of[0]
        for more in of[1:]:
            same = same | more
        for r in at.filter(same).groupBy("t", "size", "text_crc32").agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("w")).alias("b")).collect():
            spans[r["t"], r["size"], r["text_crc32"]] = (r["a"], r["b"])
    cuts = []
    for c in even:
        r = found.get(c)
        nearer = lambda a, b, c=c: a if c - a <= b - c else b
        own = nearer(r["at"], r["at"] + r["w"]) if r else c
        group = spans.get((r["t"], r["size"], r["text_crc32"])) if r else None
        moved = nearer(*group) if group else own
        cuts.append(moved if abs(moved - c) <= give * total / shards else own)
    return sorted(cuts)


def shard_rows(docs: DataFrame, key="doc_id", text="text", dimensions=DIMENSIONS, shards=SHARDS, bits=BITS, law="bytes", give=GIVE) -> DataFrame:
    """One row per document: ``k``, ``t``, ``size``, ``text_crc32``, ``copies``, ``curve``, ``shard``, ``slot``."""
    if law not in ("bytes", "rows"):
        raise ValueError("the law is 'bytes' or 'rows'")
    return place(curve_rows(docs, key, text, dimensions, bits), shards, law, give)


def sharded(docs: DataFrame, key="doc_id", text="text", **how) -> DataFrame:
    """The documents with ``shard`` and ``curve`` (or underscored names), in files along the curve.

    Rows that share key and text go to one shard.
    """
    k, t, shard, curve = fresh(docs, "shard_k", "shard_t", "shard", "curve")
    found = shard_rows(docs, key, text, **how).groupBy("k", "t").agg(F.min("shard").alias(shard), F.min("curve").alias(curve))
    found = found.withColumnsRenamed({"k": k, "t": t})
    body = F.encode(F.coalesce(column(text).cast("string"), F.lit("")), "UTF-8")
    met = docs.join(found, column(key).eqNullSafe(column(k)) & (F.xxhash64(body) == column(t))).drop(k, t)
    return met.repartitionByRange(column(shard), column(curve), column(key)).sortWithinPartitions(shard, curve)
