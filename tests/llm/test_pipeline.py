from __future__ import annotations

import ast
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from foliolens.llm.common import stored, table
from foliolens.llm.decontamination import LeakFinder
from foliolens.llm.mixing import mix_sizes
from foliolens.llm.simhash import fingerprint
from tests.llm.test_simhash import classes

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent.parent


@pytest.fixture(scope="module")
def steps(spark):
    """The documents before the first and after each stage."""
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF)))
    return docs


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "mixing", "sharding"]
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "curve"]


def test_near_copies(steps):
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in steps[1:3])
    keys = sorted(before)
    prints = [fingerprint(before[k].encode()) & (1 << 64) - 1 for k in keys]
    distinct = sorted(set(prints))
    own = dict(zip(distinct, classes(distinct), strict=True))
    least: dict[int, int] = {}
    for k, p in zip(keys, prints, strict=True):
        least.setdefault(own[p], k)
    assert sorted(after) == sorted(least.values()) and all(after[k] == before[k] for k in after)


def test_leaks(spark, steps):
    finder = LeakFinder([r["text"] for r in table(spark, SF, "benchmark").collect()])
    before = steps[2].collect()
    clean = [r for r, f in zip(before, finder.find([r["text"] for r in before]), strict=True) if not f]
    assert Counter(map(tuple, steps[3].collect())) == Counter(map(tuple, clean))


def test_mix(steps):
    """Documents stay whole; each appears its whole number of times or once more, and
    where nothing is left over exactly that often. One of each shard and source has such a rest."""
    sizes = mix_sizes(steps[3]).collect()
    texts = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    times = Counter()
    for r in steps[4].collect():
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        times[r["doc_id"]] += 1
    rests = Counter()
    for r in sizes:
        whole, rest = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        assert whole <= times[r["k"]] <= whole + (rest > 0)
        rests[r["source"], r["shard"]] += rest > 0
    assert max(rests.values()) <= 1 and set(times) <= {r["k"] for r in sizes if r["taken"]}


def test_shards(steps):
    assert Counter(r[:5] for r in map(tuple, steps[5].collect())) == Counter(map(tuple, steps[4].collect()))
    assert {r["shard"] for r in steps[5].collect()} <= set(range(16))


def test_run(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, steps[5].collect()))


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "foliolens").rglob("*.py"):
        if path.parent.name != "llm":
            names = [getattr(n, "module", None) or "" for n in ast.walk(ast.parse(path.read_text()))]
            assert not any("llm" in n for n in names) and "foliolens.llm" not in path.read_text()
