"""Times the headline queries and prints one JSON line.

Every query runs once to warm the JVM up and then twice; the better of the two
counts. Each run plans the query from the stored tables and writes every result
row to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from foliolens.operators.audit import attributed_rows, waterfall
from foliolens.operators.metrics import all_levels
from foliolens.plans.pipeline import ViewResult, run_views
from foliolens.plans.session import tune
from foliolens.registry.inputs import lookthroughs, positions, rule, test, view_set
from foliolens.registry.view_queries import HOLD, flagship

RUNS = 2
#: Tasks that share a table; the given ones have a single row group each.
SPREAD = int(os.environ.get("BENCH_CPUS", "8"))


def session(cores: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("foliolens-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def views(number: int, rescale: bool):
    """That many perspectives: a filter rule and a scaling rule each."""
    rules = {
        str(-n): {
            "rules": [
                rule(test("trade_type_id", "<=", n % 5 + 1)),
                rule(test("liquidity_type_id", ">", n % 9), percent=50),
            ]
        }
        for n in range(1, number + 1)
    }
    return view_set({"main": {pid: [HOLD] if rescale else [] for pid in rules}}, rules)


def evaluate(spark: SparkSession, folder: str, number: int, rescale: bool) -> ViewResult:
    pos, lt = positions(spark, folder, SPREAD), lookthroughs(spark, folder, SPREAD)
    return run_views(pos, lt, views(number, rescale))


def view_frames(number: int, rescale: bool):
    """Both result frames, and the scale factors when there are some."""

    def run(spark: SparkSession, folder: str) -> list[DataFrame]:
        result = evaluate(spark, folder, number, rescale)
        frames = [result.positions, result.lookthroughs]
        return frames + ([result.scale_factors] if rescale else [])

    return run


def metrics(spark: SparkSession, folder: str) -> list[DataFrame]:
    result = evaluate(spark, folder, 3, True)
    factors = result.all_scale_factors
    return [all_levels(result.positions, result.lookthroughs, scale_holdings=True, factors=factors)]


def audit(spark: SparkSession, folder: str) -> list[DataFrame]:
    pos, lt = positions(spark, folder, SPREAD), lookthroughs(spark, folder, SPREAD)
    return [waterfall(attributed_rows(pos, lt, views(10, False), ["initial_weight"]), ["initial_weight"])]


QUERIES = {
    "flagship": lambda spark, folder: [flagship(spark, folder)],
    **{
        f"views_{n}{'_rescaled' if rescale else ''}": view_frames(n, rescale)
        for n in (1, 10, 50)
        for rescale in (False, True)
    },
    "metrics_all_levels": metrics,
    "audit_waterfall": audit,
}


def timed(spark: SparkSession, folder: str, run) -> float:
    start = time.perf_counter()
    for frame in run(spark, folder):
        frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(str(SPREAD))
    wanted = sys.argv[1:]
    seconds = {}
    for name, run in QUERIES.items():
        if wanted and name not in wanted:
            continue
        timed(spark, folder, run)
        seconds[name] = round(min(timed(spark, folder, run) for _ in range(RUNS)), 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
