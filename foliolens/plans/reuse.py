"""Storing frames that several outputs read, instead of computing them again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_OWN: ContextVar[str | None] = ContextVar("own_folder", default=None)

FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
"""Settings under which the shuffle files of a run go at its end, and not when the driver collects its garbage."""
DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
"""Settings under which rows that are dealt by some keys of a join are not dealt again by all of them."""


def shared_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for intermediate frames."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def _run_folder(spark: SparkSession) -> str:
    own = _OWN.get()
    if own:
        return own
    folder = shared_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a shared folder to store intermediate frames")
    return f"{folder.rstrip('/')}/foliolens-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{_run_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned and run in this block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with settings(df.sparkSession, FREED):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Writes the frame as a table in the shared folder and reads it back.

    The files outlive executors, and later stages read only the columns they
    need. They stay until ``clear_stored`` or the end of ``own_frames``; the shuffle
    files that they were made from go at once.
    """
    return _stored(df, new_folder(df.sparkSession))


def materialize_if_possible(df: DataFrame) -> DataFrame:
    """The same where the session names such a folder, else the frame itself."""
    return materialize(df) if shared_folder(df.sparkSession) else df


@contextmanager
def stored_while(df: DataFrame, values: dict[str, str] | None = None) -> Iterator[DataFrame]:
    """The same for a block, at whose end the files go: nothing may read them after it, lazy frames included.

    ``values`` are settings for writing them. Without a folder it is the frame itself.
    """
    if not shared_folder(df.sparkSession):
        yield df
        return
    path = new_folder(df.sparkSession)
    try:
        with settings(df.sparkSession, values or {}):
            stored = _stored(df, path)
        yield stored
    finally:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_stored(spark: SparkSession) -> None:
    """Deletes the frames that this application, or the present ``own_frames``, has stored."""
    if shared_folder(spark):
        _delete(spark, _run_folder(spark))


@contextmanager
def own_frames(spark: SparkSession) -> Iterator[None]:
    """Frames stored in this block have a folder of their own, which goes when the block ends, also by an error.

    What reads them has to be written before that. Blocks may run beside each other
    in several threads, and inside each other.
    """
    folder = new_folder(spark) if shared_folder(spark) else None
    token = _OWN.set(folder or _OWN.get())
    try:
        yield
    finally:
        _OWN.reset(token)
        if folder:
            _delete(spark, folder)
