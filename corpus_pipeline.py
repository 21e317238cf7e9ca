"""Corpus pipeline: documents through five of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)``; ``run`` writes every stage's result
to the shared folder and reads it back as the next one's ``docs``, the last one's
too; then the stage's scratch tables and its input go, so of a run only its
result is left, which later runs don't touch.  All stages but the last return the
columns of documents, whatever their names.  Null and empty texts have no words,
so the first stage rejects them; a null id is an id of its own; an empty table
passes through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.llm import common, decontam, packing, rules, simhash, suffix

ORACLE_SQL = None  # hashing, suffix sorting and token ids are beyond SQL; tests compare with brute force


@common.stage(first=True)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules reject go."""
    return rules.filter_documents(docs)


@common.stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the least id."""
    return simhash.one_of_each(docs)


@common.stage
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut out; ``n_chars`` is counted anew where the text has changed."""
    size = "_p_size"
    while size in docs.columns:
        size += "_"
    cut = suffix.without_repeats(docs.withColumn(size, F.length("text")))
    if "n_chars" in docs.columns:
        same = F.length("text").eqNullSafe(F.col(size))
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut.select(*docs.columns)


@common.stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaks(docs, common.table(spark, sf_dir, "benchmark"))


@common.stage
def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("token_packing", token_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scratch: list[str] = []
    for name, stage in STAGES:
        docs, path = common.written(stage(spark, docs, sf_dir), f"after-{name}")
        common.drop(spark, [*common.take(), *scratch])
        scratch = path
    return docs
