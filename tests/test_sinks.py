"""Result files that are read back: scale factors are rounded per container, not for each row beside them."""

from __future__ import annotations

from foliolens import datasets
from foliolens.registry.output_queries import QUERIES


def test_factors_are_rounded_before_rows_meet_them(spark, tmp_path):
    orders = [(1, 15, "F", 100.25, "1-URGENT"), (2, 15, "F", 33.5, "5-LOW"), (3, 27, "O", 10.0, "1-URGENT")]
    lines = [(1, 7, 2, 1, 8.0, 10.5, "N"), (3, 9, 2, 1, 16.0, 20.5, "R")]
    for name, rows in (("orders", orders), ("lineitem", lines)):
        spark.createDataFrame(rows, datasets.COLUMNS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = QUERIES["R-06_sinks"][0](spark, str(tmp_path))
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "round(" not in above, above
    found = rows.collect()
    assert {r["identifier"] for r in found} >= {"1", "3"}
    assert all(r["scale_factor"] == round(r["scale_factor"], 9) for r in found)
