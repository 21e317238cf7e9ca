"""Each stage against a plain version, on its own input."""

import brute
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from pitwall.llm import common, decontam, rules

SF = "/root/testdata/sf0.001"


def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.saved(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        kept[name] = (plain(before), plain(docs), before, docs)

    given, out, before, _ = kept["quality_rules"]
    frame = before.toPandas()
    want = brute.sql(rules.OP3_SQL, documents=frame).fetchall()
    verdict = {r[0]: r[-1] for r in want}
    assert sorted(i for i, _ in out) == sorted(i for i, _ in given if verdict[i])

    given, out, _, _ = kept["simhash_dedup"]
    assert sorted(i for i, _ in out) == sorted({c for _, _, c in brute.simhash_classes(given)})

    given, out, before, after = kept["suffix_dedup"]
    given = sorted(given)
    cut = [bytes(np.frombuffer(raw, np.uint8)[~m]).decode(errors="ignore") for raw, m in brute.suffix_masks([t for _, t in given])]
    assert sorted(out) == [(i, c) for (i, _), c in zip(given, cut)]
    changed = after.filter(F.length("text") != F.col("n_chars")).join(before.filter(F.length("text") == F.col("n_chars")), "doc_id", "left_semi")
    assert changed.isEmpty()

    given, out, before, _ = kept["decontamination"]
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    leaks = {r[0] for r in brute.sql(decontam.OP6_SQL, documents=before.toPandas(), benchmark=bench).fetchall()}
    assert sorted(out) == sorted(d for d in given if d[0] not in leaks)

    pieces = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]
    padding, total = brute.check_packing(pieces, plain(docs))
    assert padding < 1024
    ran = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert {r["doc_id"] for r in ran.select(*key).collect()} == {p["doc_id"] for p in pieces}
    assert ran.agg(F.sum("length")).first()[0] == total


def test_two_runs_in_a_session(spark):
    one = corpus_pipeline.run(spark, SF)
    first = sorted(map(tuple, one.collect()))
    two = corpus_pipeline.run(spark, SF)
    key = ("doc_id", "start", "length", "ids_crc32")
    assert sorted(map(tuple, one.collect())) == first
    assert sorted(map(tuple, two.select(*key).collect())) == sorted(map(tuple, one.select(*key).collect()))


def test_stages_stand_nulls_repeats_extra_columns_and_empty_tables(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text + " more", None, None, None), (3, None, "en", "a", None), (4, "", None, "a", 0),
            (5, " ".join(f"other{i}" for i in range(90)), "de", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("kept", F.lit("k")).withColumn("fingerprint", F.lit(1)).withColumn("rid", F.lit(2)).withColumn("start", F.lit(3))
    reserved = ("_s_text", "_d_text", "_p_size", "_s_row", "_d_row", "_x_rid")
    for k, c in enumerate(reserved):
        docs = docs.withColumn(c, F.lit(f"own {k}"))
    for given in (docs, docs.limit(0)):
        out = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.saved(stage(spark, out, SF), f"edge-{name}")
            assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*reserved).collect()} <= {tuple(f"own {k}" for k in range(len(reserved)))}
        pieces = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
        assert {r["doc_id"] for r in pieces} == ({1, 5} if given is docs else set())
