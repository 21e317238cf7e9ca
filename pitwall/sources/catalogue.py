"""Write, audit, publish: immutable versions and a pointer that is replaced atomically.

A published table or model is a folder with ``versions/<name>`` and one small
file, ``_CURRENT``, that names the version readers take.  A version is written
under a name that nobody reads, then the pointer is replaced by a rename, which
the file system does as a whole: a crash at any point leaves the version before
readable.  A writer that lost its race or crashed leaves a version without
readers; ``sweep`` deletes those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import rules_of, violations

POINTER = "_CURRENT"


class ContractViolation(ValueError):
    """The audit failed; ``counts`` has the rows and the violations per severity."""

    def __init__(self, counts: dict):
        super().__init__(f"not published: {counts}")
        self.counts = counts


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.delete(path, True)


def current(spark: SparkSession, base: str) -> str | None:
    """The name of the committed version, or None."""
    path, fs = _path(spark, f"{base.rstrip('/')}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode().strip()
    finally:
        stream.close()


def point(spark: SparkSession, base: str, version: str) -> None:
    """Make ``version`` the one that readers take, by one rename over the pointer."""
    jvm = spark.sparkContext._jvm
    base = base.rstrip("/")
    new, fs = _path(spark, f"{base}/{POINTER}-{uuid.uuid4().hex}")
    stream = fs.create(new, False)
    stream.write(bytearray(version.encode()))
    stream.close()
    target, _ = _path(spark, f"{base}/{POINTER}")
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(new, target, how)


def version_path(base: str, version: str) -> str:
    return f"{base.rstrip('/')}/versions/{version}"


def publish(df: DataFrame, base: str, rules: DataFrame, contract: str, format: str = "parquet", version: str | None = None,
            allowed: int = 0, **options) -> dict:
    """Write ``df`` once, auditing it on the way; readers see it only if at most ``allowed`` rows violate an error rule.

    The counts (``rows``, ``errors``, ``warnings``: rows that violate a rule) are
    observed by the writing tasks themselves, so nothing is read twice.  An empty
    table is refused too.  Returns the counts and the version's name.
    """
    spark = df.sparkSession
    found = rules_of(rules, contract)
    version = version or uuid.uuid4().hex
    path = version_path(base, version)
    bad = lambda s: F.count_if(F.size(violations(df, found, s)) > 0)
    seen = Observation("audit")
    audited = df.observe(seen, F.count(F.lit(1)).alias("rows"), bad("error").alias("errors"), bad("warning").alias("warnings"))
    audited.write.format(format).options(**options).mode("errorifexists").save(path)
    counts = dict(seen.get)
    if not counts["rows"] or counts["errors"] > allowed:
        delete(spark, path)
        raise ContractViolation(counts)
    point(spark, base, version)
    return {**counts, "version": version}


def read_published(spark: SparkSession, base: str, format: str = "parquet", **options) -> DataFrame:
    """The committed version; raises if there is none."""
    version = current(spark, base)
    if version is None:
        raise FileNotFoundError(f"nothing is published in {base}")
    return spark.read.format(format).options(**options).load(version_path(base, version))


def sweep(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete all but the committed version and the ``keep - 1`` newest others; returns the names of those deleted."""
    here = current(spark, base)
    path, fs = _path(spark, f"{base.rstrip('/')}/versions")
    if not fs.exists(path):
        return []
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path)), reverse=True)
    others = [name for _, name in found if name != here]
    for name in others[max(keep - 1, 0):]:
        delete(spark, version_path(base, name))
    return others[max(keep - 1, 0):]
