"""Written tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []  # tables written by ``saved``, and folders, that haven't been released


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set on the context.

    Only a single-machine ``local`` session in which neither is set gets a
    folder of its own; any other master must name a shared one.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pitwall-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared one; ``release`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/pitwall-{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished work.

    Its cleaner does so once the driver's garbage is collected, which a driver
    with little to do puts off; for jobs of many steps on one table.  Spark's
    threads may hold the last step a moment longer, hence several times.
    """
    for pause in (0.0, 0.3, 0.6):
        time.sleep(pause)
        gc.collect()  # frames that Python still holds in cycles
        spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that ``saved`` has written (from the ``since``-th on); frames that read them are used up.

    Returns how many.  Call it when the results that were built on them are
    written or collected; ``scope`` does so at the end of a block.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made) - since
    while len(_made) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return max(n, 0)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Release, at the end of the block, the tables that were written inside it."""
    since = len(_made)
    try:
        yield
    finally:
        release(spark, since)
