"""Token ids as ORC: run-length encoded integers, row indexes, Bloom filters.

Documents are dealt out by ranges of (doc_id, text hash), sorted, encoded with
a public tokenizer, and written by Spark's ORC writer: ``ids`` is an integer
column, run-length encoded within a stripe; every ``ROW_INDEX`` rows have
minima and maxima, and ``doc_id`` has a Bloom filter, so that readers by id skip
stripes and row groups.  A stripe is the unit of reading, so large files are
read in parallel.  ``part`` and ``before`` (ids before the document in its part)
make a document's place known without reading other documents.

Null texts count as empty ones (only the end id).  Equal ids are ordered by the
hash of their text, null ids come first; an empty table gives no rows; very long
texts are encoded whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, table
from .tokens import byte_bpe_path, encoder

END_ID = 0
STRIPE_BYTES = 16 << 20
ROW_INDEX = 1000
WRITE_IDS = 1 << 20  # ids that a task hands over at a time
BLOOM_FPP = 0.01


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""
    tokenizer = tokenizer or byte_bpe_path()
    order = ["doc_id", "_t_hash"]
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_t_hash")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc, before = TaskContext.get().partitionId(), encoder(tokenizer), 0
        def result(ids, got):
            nonlocal before
            n = np.array([len(x) for x in got], dtype=np.int64)
            at = before + np.r_[0, np.cumsum(n)]
            before = int(at[-1])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate(got)))
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(len(n), part, np.int32)), pa.array(at[:-1]), pa.array(n), lists],
                ["doc_id", "part", "before", "n_tokens", "ids"],
            )

        for b in batches:
            got, size, first = [], 0, 0
            for x in enc.encode(b.column("text")):
                got.append(np.append(x, np.uint32(END_ID)).view(np.int32))
                size += len(x)
                if size >= WRITE_IDS:
                    yield result(b.column("doc_id")[first : first + len(got)], got)
                    got, size, first = [], 0, first + len(got)
            if got:
                yield result(b.column("doc_id")[first:], got)

    schema = docs.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("part", "int"), ("before", "long"), ("n_tokens", "long"), ("ids", "array<int>"))]).schema
    (
        ordered.mapInArrow(run, schema).write
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", ROW_INDEX)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", "lz4")
        .orc(path)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``doc_ids``, only theirs, by ORC's minima, maxima and Bloom filters."""
    df = spark.read.orc(path)
    return df if doc_ids is None else df.filter(F.col("doc_id").isin(doc_ids))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids before each part; reads two small columns, gives a row for each part."""
    ends = spark.read.orc(path).groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    return ends.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    rows = read(spark, path)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids = b.column("ids")
            flat, at = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "part", "before", "n_tokens")] + [pa.array(crc, pa.int64())],
                                             ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    schema = rows.select("doc_id", "part", "before", "n_tokens", F.lit(0).cast("long").alias("ids_crc32")).schema
    got = rows.mapInArrow(run, schema)
    return got.join(F.broadcast(starts(spark, path)), "part").select(  # a row for each part
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return digests(spark, path)
