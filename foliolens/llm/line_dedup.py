"""Line dedup: repeated windows of consecutive lines, found over all documents.

Every run of three consecutive lines of a document is a window. A window whose
lines occur earlier (smaller key, or the same document further up) marks its
lines; marked lines are merged to spans and removed. Windows are judged on the
input, not on what is left.

Only DataFrame functions are used. Windows travel as two 64-bit hashes, a key and
a position; the first occurrence is a partial aggregate, so frequent passages
are combined before they are shuffled, and the join back to the windows is one
that adaptive execution can split. Texts meet their spans in one join by key.

Edge cases: a null text stays null with no lines; an empty text is one empty
line; documents of fewer than three lines have no window. Rows that share key and
text are one occurrence: neither is later than the other, both lose the same
lines. A null key sorts first. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliolens.llm.common import column, fresh

WINDOW = 3


def _window_hashes(lines: str, width: int):
    """Two hashes of each window, as an array in order of position."""
    parts = ", ".join(f"{lines}[i + {j}]" for j in range(width))
    back = ", ".join(f"{lines}[i + {j}]" for j in reversed(range(width)))
    each = f"transform(sequence(0, size({lines}) - {width}), i -> struct(xxhash64({parts}) AS a, xxhash64('', {back}) AS b))"
    return F.expr(f"CASE WHEN size({lines}) >= {width} THEN {each} END")


def removed_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Per document with repeated windows: ``k`` (key), ``t`` (hash of the text),
    ``spans`` (first line from 0 and the line after the last, in order)."""
    named = docs.select(column(key).alias("k"), column(text).cast("string").alias("x")).filter("x IS NOT NULL")
    lines = named.select("k", F.xxhash64("x").alias("t"), F.split("x", "\n").alias("l"))
    windows = lines.select("k", "t", F.posexplode(_window_hashes("l", width)).alias("pos", "h")).select(
        "k", "t", "pos", "h.a", "h.b"
    )
    firsts = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("k", "pos")).alias("first"), F.max(F.struct("k", "pos")).alias("last"))
        .filter("first < last")
        .select("a", "b", "first")
    )
    later = windows.join(firsts, ["a", "b"]).filter(F.struct("k", "pos") > F.col("first"))
    # Rows that share key and text bring the same positions more than once; they merge as well.
    order = Window.partitionBy("k", "t").orderBy("pos")
    begun = (F.col("pos") > F.lag("pos").over(order) + width).cast("int")
    runs = later.select("k", "t", "pos", F.coalesce(begun, F.lit(0)).alias("new")).select(
        "k", "t", "pos", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run")
    )
    spans = runs.groupBy("k", "t", "run").agg(F.min("pos").alias("s"), (F.max("pos") + width).alias("e"))
    return spans.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines``, ``n_removed`` and ``spans``
    (names that are taken get a leading underscore)."""
    kept, total, gone, spans, k, t, lines = fresh(
        docs, "kept_text", "n_lines", "n_removed", "spans", "span_k", "span_t", "line_list"
    )
    found = removed_spans(docs, key, text, width).withColumnsRenamed({"k": k, "t": t, "spans": spans})
    body = column(text).cast("string")
    joined = docs.join(
        found, column(key).eqNullSafe(column(k)) & (F.xxhash64(body) == column(t)), "left"
    ).withColumn(lines, F.split(body, "\n"))
    size = F.when(body.isNull(), 0).otherwise(F.size(lines))
    none = F.array().cast("array<struct<s:int,e:int>>")
    marked = F.coalesce(column(spans), none)
    starts = F.concat(F.array(F.lit(0)), F.transform(marked, lambda s: s["e"]))
    ends = F.concat(F.transform(marked, lambda s: s["s"]), F.array(F.size(lines)))
    gaps = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(column(lines), s + 1, e - s)))
    return joined.select(
        *[column(c) for c in docs.columns],
        F.when(column(spans).isNull(), body).otherwise(F.array_join(gaps, "\n")).alias(kept),
        size.cast("long").alias(total),
        F.aggregate(marked, F.lit(0), lambda n, s: n + s["e"] - s["s"]).cast("long").alias(gone),
        marked.alias(spans),
    )
