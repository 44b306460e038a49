"""Token ids of documents as ORC files.

The documents are sorted by key over range partitions, encoded, and each partition
becomes one ORC file. Ids are a list of integers, which ORC stores in stripes by
integer run-length encoding. Every stripe has row indexes and a Bloom filter on the
key, so ``documents_by_key`` reads the row groups that may hold the wanted keys
only, and stripes are read in parallel by however many tasks Spark cuts the files
into. ``part`` and ``offset`` place a document: ids of the same file before it.

Encoding: a text is cut into units at white space, each with the one space before
it. No token of a byte-level vocabulary crosses such a cut, since white space is
matched apart from what follows it but for that one space, so the ids of the units
are those of the whole text. Units repeat; their ids are kept in a bounded cache.

Edge cases: null and empty texts are the end id alone. Null keys come first.
Repeated keys follow in the order of their texts' hashes, repeated rows in any.
Empty tables write empty files and read as empty. Extra columns are not written.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from foliolens.llm.common import column, small_batches

END = 2
#: Units whose ids a Python worker keeps, and the characters of the longest of them.
CACHED, LONGEST = 1 << 20, 64
#: Rows of a row group, which has its own statistics and Bloom filter; bytes of a stripe.
GROUP_ROWS, STRIPE = 1000, 32 << 20

# The characters that Unicode calls white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words of letters alone and the marks after them, else everything up to white space; then white space.
UNIT = re.compile(
    rf" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,;:!?{SPACE}]|\Z)|[.,;:!?]+(?=[{SPACE}]|\Z)"
    rf"| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


#: Letters by which a byte-level vocabulary writes the bytes: Latin ones stand for themselves, the others follow from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + n for n, b in enumerate(sorted({*range(256)} - {*SHOWN}))}


class Encoder(dict):
    """Ids of units as little-endian bytes; a unit that isn't kept is encoded.

    Units are those of byte-level vocabularies that change no text before they split it;
    other tokenizers get whole texts.
    """

    def __init__(self, tokenizer: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        super().__init__()
        self._tokenizer, self._cached = Tokenizer.from_str(tokenizer), cached
        self._model = self._tokenizer.model
        about = json.loads(tokenizer)
        split = about["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self._by_unit = plain and about["normalizer"] is None
        self._added = [t["content"] for t in about["added_tokens"]]

    def _encoded(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > LONGEST:
            return self._encoded(unit)
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():  # one word for the model
            tokens = self._model.tokenize(unit.encode().decode("latin-1").translate(LETTERS))
            ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        else:
            ids = self._encoded(unit)
        if len(self) >= self._cached:
            self.clear()
        self[unit] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self._by_unit or any(t in text for t in self._added):  # texts are cut at added tokens before all else
            return self._encoded(text)
        return b"".join(map(self.__getitem__, UNIT.findall(text)))


def worker_encoder(tokenizer: str) -> Encoder:
    """The encoder of this Python worker, which keeps its units from task to task.

    Functions travel by value, so a module of the worker itself holds it.
    """
    name = f"_encoder_{zlib.crc32(tokenizer.encode())}"
    held = sys.modules.setdefault("foliolens_worker", types.ModuleType("foliolens_worker"))
    if not hasattr(held, name):
        setattr(held, name, Encoder(tokenizer))
    return getattr(held, name)


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id", text: str = "text", end: int = END,
    group_rows: int = GROUP_ROWS, stripe: int = STRIPE,
) -> None:
    """Writes ``doc_id, part, offset, n_tokens, ids`` in ascending order of the key.

    The vocabulary is read by the driver and travels with the function.
    """
    model, last = Path(tokenizer_file).read_text(encoding="utf-8"), np.uint32(end).astype("<u4").tobytes()
    kind = docs.schema[key].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType()),
         T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    arrow_key = to_arrow_type(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, offset, part = worker_encoder(model), 0, TaskContext.get().partitionId()
        for batch in batches:
            data = [encoder.ids(x) + last if x else last for x in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in data)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4"), pa.int32()))
            yield pa.record_batch(
                [batch.column(0).cast(arrow_key), pa.array(np.full(len(data), part), pa.int32()), pa.array(offset + ends[:-1], pa.int64()),
                 pa.array(np.diff(ends), pa.int32()), ids],
                names=schema.names,
            )
            offset += int(ends[-1])

    rows = small_batches(docs).select(column(key).alias("k"), F.coalesce(column(text).cast("string"), F.lit("")).alias("x"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("x").asc()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (
        ranged.mapInArrow(encode, schema)
        .write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(group_rows)).option("orc.stripe.size", str(stripe))
        .option("compression", "zstd").option("maxRecordsPerFile", "0")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def documents_by_key(spark: SparkSession, path: str, keys: list) -> DataFrame:
    """The documents with these keys; row groups without them are not read."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(keys))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    rows = read_tokens(spark, path)
    kept = T.StructType([f for f in rows.schema if f.name != "ids"] + [T.StructField("ids_crc32", T.LongType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64())], names=kept.names)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per file
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    found = rows.select("doc_id", "part", "offset", "n_tokens", "ids").mapInArrow(digest, kept)
    return found.join(files, "part").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32"
    )
