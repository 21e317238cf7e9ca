"""Structured Streaming forms of two batch flows.

The original answered one uploaded file at a time and kept expert overrides
in a file it rewrote on every change.  On Spark both become incremental:

* :func:`forecast_files` -- every new point file landing in a folder is a
  micro-batch; the profile-B forecast is a stateless projection, appended to
  the sink exactly once per file (file source + checkpointed sink).
* :func:`current_override_state` -- the override log as a stream; the latest
  entry per id is a streaming aggregation whose state lives in the query's
  checkpoint (shared storage), so an executor loss replays from there.

Checkpoint folders default to ``<spark.checkpoint.dir>/<name>``; the
session's setting is read, never replaced.
"""

from __future__ import annotations

import contextlib
import datetime as _dt
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import normalise
from ..operators.forecast import forecast_b
from ..operators.overrides import current_overrides
from ..schema import OVERRIDE_SCHEMA, ForecastB
from ..scratch import shared_dir

FORECAST_INPUT_SCHEMA = T.StructType(
    [
        T.StructField("id_number", T.StringType()),
        T.StructField("average_corrosion_rate", T.DoubleType()),
        T.StructField("thickness_mm", T.DoubleType()),
        T.StructField("commodity", T.StringType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("cml_shape", T.StringType()),
        T.StructField("last_inspection_date", T.StringType()),
    ]
)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}"


def read_point_files(spark: SparkSession, folder: str, fmt: str = "csv",
                     schema: T.StructType = FORECAST_INPUT_SCHEMA, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming source over a folder of point files (CSV with header, or parquet)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        r = r.option("header", True)
    return normalise(r.format(fmt).load(folder))


def forecast_files(spark: SparkSession, folder: str, fmt: str = "csv", *, as_of: _dt.date,
                   profile: ForecastB = ForecastB()) -> DataFrame:
    """Streaming DataFrame: the profile-B forecast of every arriving point row."""
    return forecast_b(read_point_files(spark, folder, fmt), as_of=as_of, profile=profile)


def start_forecast_sink(stream: DataFrame, out_path: str, checkpoint: str, fmt: str = "parquet",
                        trigger_once: bool = False):
    """Append forecasts to ``out_path``; exactly-once via the checkpoint."""
    w = stream.writeStream.format(fmt).option("path", out_path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def read_override_log_stream(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(OVERRIDE_SCHEMA).format(fmt).load(folder)


def current_override_state(log_stream: DataFrame) -> DataFrame:
    """Latest override per id as a streaming aggregation (use output mode 'update' or 'complete').

    The same ``min(struct(...))`` aggregate as the batch operator: its state
    is one struct per id, and partial aggregation runs before the shuffle.
    """
    return current_overrides(log_stream)


BUCKETS = 64
TASK_ROWS = 500_000  # rows that a task reads, merges or writes, roughly: what it sorts doesn't grow with the table


def _folders(spark: SparkSession, target: str, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath().toString()) for f in found or []]


def version_numbers(spark: SparkSession, target: str) -> list[int]:
    """The committed versions, ascending."""
    return sorted(int(p.rpartition("=")[2]) for p in _folders(spark, target, "_committed/v=*"))


def _current(spark: SparkSession, target: str, below: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """bucket -> its committed (version, folder) pairs, newest first; at most a few per bucket."""
    done = set(version_numbers(spark, target))
    out: dict[int, list[tuple[int, str]]] = {}
    for p in _folders(spark, target, "v=*/bucket=*"):
        v, b = (int(x.rpartition("=")[2]) for x in p.rsplit("/", 2)[1:])
        if v in done and (below is None or v < below):
            out.setdefault(b, []).append((v, p))
    return {b: sorted(x, reverse=True) for b, x in out.items()}


def apply_state_batch(batch: DataFrame, batch_id: int, target: str, buckets: int = BUCKETS) -> None:
    """``foreachBatch`` helper: upsert a micro-batch of state rows into a table at ``target``.

    The state is kept in buckets of ids.  A batch rewrites only the buckets it
    touches: their newest version *below* ``batch_id`` minus the batch's ids plus
    the batch, written under ``v=<batch_id>`` and then marked as committed.
    Readers see committed versions only, so a failed batch changes nothing and a
    replayed one writes the same again.  Each bucket keeps its two newest
    versions (the older one serves a replay); older ones are deleted after the
    commit.
    """
    spark = batch.sparkSession
    # used three times below; kept, so that the stateful aggregation runs once
    batch = batch.withColumn("bucket", F.pmod(F.xxhash64("id_number"), F.lit(buckets)).cast("int")).persist()
    try:
        _rewrite(spark, batch, batch_id, target)
    finally:
        batch.unpersist()


def _rewrite(spark: SparkSession, batch: DataFrame, batch_id: int, target: str) -> None:
    counts = bucket_counts(batch)
    before = _current(spark, target, below=batch_id)
    paths = [before[b][0][1] for b in counts if b in before]
    merged = batch
    if paths:
        prev = spark.read.option("basePath", target).parquet(*paths).select(*batch.columns)
        merged = prev.join(batch.select("id_number"), "id_number", "left_anti").select(*batch.columns).unionByName(batch)
        counts = bucket_counts(prev, counts)
    with sized(spark, shuffled=sum(counts.values())):
        by_bucket(merged, counts).write.mode("overwrite").partitionBy("bucket").parquet(f"{target.rstrip('/')}/v={batch_id}")
    commit(spark, target, batch_id)


def bucket_counts(rows: DataFrame, more: dict[int, int] | None = None) -> dict[int, int]:
    """Rows of each bucket (at most ``buckets`` numbers), added to ``more``."""
    out = dict(more or {})
    for bucket, n in rows.groupBy("bucket").count().collect():
        out[bucket] = out.get(bucket, 0) + n
    return out


@contextlib.contextmanager
def sized(spark: SparkSession, read: int = 0, shuffled: int = 0):
    """Inside the block, so many rows are read from files, or shuffled, in parts of some ``TASK_ROWS`` rows.

    Raises the session's numbers of parts, which are put back afterwards; never lowers them.
    """
    wanted = {"spark.sql.files.minPartitionNum": (read, spark.sparkContext.defaultParallelism),
              "spark.sql.shuffle.partitions": (shuffled, 200)}
    before = {}
    try:
        for key, (rows, default) in wanted.items():
            now, parts = spark.conf.get(key, None), math.ceil(rows / TASK_ROWS)
            if int(now or default) < parts:
                before[key] = now
                spark.conf.set(key, str(parts))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def by_bucket(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rows of a bucket together, but a bucket of more than ``TASK_ROWS`` rows shared out by id over several tasks.

    ``counts`` gives each bucket's rows, or more.  Up to ``TASK_ROWS`` rows in all, adaptive execution shares
    buckets out by the session's advisory partition size.
    """
    if sum(counts.values()) <= TASK_ROWS:
        return rows.hint("rebalance", "bucket")
    shares = [math.ceil(counts.get(b, 0) / TASK_ROWS) for b in range(max(counts) + 1)]
    first = [sum(shares[:b]) for b in range(len(shares))]
    of = lambda numbers: F.get(F.array(*[F.lit(n) for n in numbers]), F.col("bucket"))
    # another hash than the bucket's, so that its ids spread over all shares
    return rows.repartitionById(sum(shares), of(first) + F.pmod(F.hash("id_number"), of(shares)))


def commit(spark: SparkSession, target: str, batch_id: int) -> None:
    """Mark version ``batch_id`` as committed, then delete what is older than a bucket's two newest versions."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/_committed/v={batch_id}")
    fs = mark.getFileSystem(conf)
    fs.create(mark, True).close()
    for versions in _current(spark, target).values():
        for _, old in versions[2:]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def latest_state(spark: SparkSession, target: str) -> DataFrame:
    """The newest committed version of every bucket; raises if nothing was committed."""
    paths = [x[0][1] for x in _current(spark, target).values()]
    if not paths:
        raise FileNotFoundError(f"no committed state at {target}")
    return spark.read.option("basePath", target).parquet(*paths).drop("v", "bucket")
