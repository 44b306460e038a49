from __future__ import annotations

import time

from foliolens.llm.line_dedup import dedup_lines
from tests.llm.rows import CLASHES, no_documents, odd_documents, odd_rows


def brute(rows, width=3):
    """Rows are (key, text); the result by key and text."""
    first = {}
    order = sorted({(k is not None, k or 0, t) for k, t in rows if t is not None})
    for o, k, t in order:
        lines = t.split("\n")
        for i in range(len(lines) - width + 1):
            place = (o, k, i)
            first[tuple(lines[i : i + width])] = min(first.get(tuple(lines[i : i + width]), place), place)
    result = {}
    for o, k, t in order:
        lines = t.split("\n")
        gone = {j for i in range(len(lines) - width + 1) if first[tuple(lines[i : i + width])] < (o, k, i) for j in range(i, i + width)}
        result[(k if o else None), t] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(lines), len(gone))
    return result


def check(spark, rows, schema="doc_id long, text string"):
    found = dedup_lines(spark.createDataFrame(rows, schema)).collect()
    want = brute([r[:2] for r in rows])
    assert len(found) == len(rows)
    for r in found:
        if r["text"] is None:
            assert (r["kept_text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
        else:
            assert (r["kept_text"], r["n_lines"], r["n_removed"]) == want[r["doc_id"], r["text"]]


def test_repeats_overlaps_and_edges(spark):
    rows = [
        (1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "b\nc\nd\ne\nb\nc\nd\ne"), (4, "q\nq\nq\nq\nq\nq"), (5, "a\nb"),
        (6, ""), (7, None), (8, "\n\n\n\n"), (None, "m\nn\no"), (9, "m\nn\no"), (5, "a\nb\nc"), (1, "a\nb\nc\nd\ne"),
    ]
    check(spark, rows)


def test_odd_rows(spark):
    check(spark, [r[:2] for r in odd_rows()])
    found = dedup_lines(odd_documents(spark))
    assert set(CLASHES) <= set(found.columns) and "_kept_text" in found.columns and found.count() == len(odd_rows())
    assert dedup_lines(no_documents(spark)).count() == 0


def test_time_is_linear_in_lines(spark):
    text = "\n".join(str(i) for i in range(100_000))
    begin = time.time()
    rows = dedup_lines(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")).select("n_removed").collect()
    assert sorted(r[0] for r in rows) == [0, 100_000] and time.time() - begin < 60
