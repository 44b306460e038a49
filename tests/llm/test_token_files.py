from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliolens.llm import token_files
from foliolens.llm.common import table
from foliolens.llm.queries import QUERIES
from foliolens.plans.reuse import new_folder
from tests.llm.rows import no_documents, odd_documents, odd_rows

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(FILE)


def encoded(text) -> bytes:
    return np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(Path(FILE).read_text(encoding="utf-8"), cached=50)


PIECES = ["word", "Été", "don\'t", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", " ", " ", "　", "\x1c", "​", "12", "½", "²", ").", "...", "<|endoftext|>", "\'s", "漢字", "\U0001f600", "_", "́"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=30).map("".join))
def test_units_are_encoded_like_the_whole(encoder, text):
    assert encoder.ids(text) + np.uint32(2).tobytes() == encoded(text)


def test_other_tokenizers_get_whole_texts():
    other = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Words, and\nothers"
    want = Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    assert token_files.Encoder(Path(other).read_text(encoding="utf-8")).ids(text) == np.array(want, "<u4").tobytes()


def check(rows, found):
    """``rows`` of (key, text) against digests, in the order of keys."""
    assert len(rows) == len(found)
    place, by_key = 0, {}
    for k, x in rows:
        by_key.setdefault(k, []).append(encoded(x))
    for r in sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"])):
        assert r["start"] == place
        place += r["n_tokens"]
        match = [i for i, x in enumerate(by_key[r["doc_id"]]) if (len(x) // 4, zlib.crc32(x)) == (r["n_tokens"], r["ids_crc32"])]
        by_key[r["doc_id"]].pop(match[0])
    assert not any(by_key.values())


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    found = QUERIES["op12_token_files"][0](spark, "/root/testdata/sf0.001").collect()
    check([(r["doc_id"], r["text"]) for r in docs.collect()], found)


def test_odd_rows(spark):
    for docs, rows in ((odd_documents(spark), odd_rows()), (no_documents(spark), [])):
        path = new_folder(spark)
        token_files.write_tokens(docs, path, FILE)
        check([r[:2] for r in rows], token_files.token_digests(spark, path).collect())


def test_files_and_pruning(spark):
    """Stripes and row groups as asked for; keys that no Bloom filter has read no rows."""
    rng = random.Random(5)
    rows = [(3 * i, " ".join(f"w{rng.randrange(99)}" for _ in range(60))) for i in range(6000)]
    path = new_folder(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    token_files.write_tokens(docs, path, FILE, group_rows=1000, stripe=1 << 17)
    local = path.removeprefix("file:")
    files = [orc.ORCFile(f) for f in Path(local).glob("*.orc")]
    assert all(f.row_index_stride == 1000 for f in files) and any(f.nstripes > 1 for f in files)

    def scanned(keys):
        df = token_files.documents_by_key(spark, path, keys)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaf = plan.collectLeaves().head()
        return got, leaf.metrics().apply("numOutputRows").value()

    got, n = scanned([300])
    assert [r["doc_id"] for r in got] == [300] and n <= 1000
    got, n = scanned([301])  # between the least and the greatest key of its row group
    assert not got and n == 0
    assert token_files.read_tokens(spark, path).agg(F.sum("n_tokens")).first()[0] == sum(len(encoded(x)) // 4 for _, x in rows)
