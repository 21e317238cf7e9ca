"""Shared helpers: scratch tables in the cluster's shared folder, SQL let-binding."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir

MAX_BROADCAST_BYTES = 64 << 20  # of a table that is broadcast, by its files

_stage: list[str] | None = None  # scratch tables of the pipeline stage that is being planned
_done: list[str] = []  # of the stage before, of the same run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table of this job in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/pitwall-{name}-{uuid.uuid4().hex}"
    if _stage is not None:
        _stage.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def stage(fn=None, *, first: bool = False):
    """A pipeline stage: when it is called, the result of the stage before is written, so its scratch tables go.

    The ``first`` stage begins a run: what it finds belongs to another run's result and stays.
    """
    if fn is None:
        return functools.partial(stage, first=first)

    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        global _stage
        if first:
            _done.clear()
        drop(spark, _done)
        _stage = _done
        try:
            return fn(spark, docs, sf_dir)
        finally:
            _stage = None

    return run


def take() -> list[str]:
    """The scratch tables of the stage called last; the caller drops them."""
    paths = list(_done)
    _done.clear()
    return paths


def written(df: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``saved``, and the path, for a caller that drops the table itself."""
    global _stage
    before, _stage = _stage, []
    try:
        out = saved(df, name)
        return out, _stage
    finally:
        _stage = before


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (a lambda variable, not an inlined copy)."""
    return F.transform(F.array(value), body)[0]


def maybe_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only if the (saved) table has at most ``max_rows`` rows and its files few bytes.

    Beyond that the join stays a shuffle join, whose hot keys AQE splits.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES and df.count() <= max_rows else df
