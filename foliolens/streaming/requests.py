"""Requests that arrive as a stream: every one is processed alone, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliolens.plans.requests import process_requests
from foliolens.plans.reuse import FREED, own_frames, settings
from foliolens.schema import REQUEST


def write_responses(requests: DataFrame, path: str, **options) -> None:
    """Response documents of a batch; running it again replaces its files.

    Refused requests have a row with an ``error`` in place of a document. What the
    batch stored on its way goes when its files are written, or when it fails, and its
    shuffle files go with it.
    """
    with own_frames(requests.sparkSession):
        run = process_requests(requests, **options)
        refused = run.errors.select(REQUEST, F.lit(0).alias("part"), F.lit(None).cast("string").alias("document"), "error")
        answered = run.documents().withColumn("error", F.lit(None).cast("string"))
        with settings(requests.sparkSession, FREED):
            answered.unionByName(refused).write.mode("overwrite").option("compression", "zstd").parquet(path)


def process_stream(
    requests: DataFrame,
    output: str,
    checkpoint: str,
    available_now: bool = False,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    **options,
) -> StreamingQuery:
    """Runs the batch plan on every micro-batch of a request stream.

    Each batch writes its own folder, ``output/batch=<number>``, so a repeated
    batch replaces itself.
    """

    def run(batch: DataFrame, number: int) -> None:
        if on_batch is not None:
            on_batch(batch, number)
        if not batch.isEmpty():
            write_responses(batch, f"{output}/batch={number}", **options)

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
