import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.llm import suffix as X


def corpus():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdeé ü\n") for _ in range(n))
    passage, other = text(140), text(99)
    out = [text(r.randint(0, 900)) for _ in range(25)]
    out += [text(200) + passage + text(r.randint(0, 300)) for _ in range(8)] + [passage, passage[:70] + passage[71:], other, other + other + other]
    out += ["z" * 500, "z" * 100, "z" * 99, "ab" * 300, None, "", out[3], out[3], out[4] + "!", "€" * 120, "x" + "€" * 120]
    return out


def check(spark, docs, expected_order=None):
    got = X.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    masks = brute.suffix_masks([t for _, t in docs])
    want = sorted((i, *brute.suffix_digest(*m)) for (i, _), m in zip(docs, masks))
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("hot,spread,block", [(100_000, 1000, 1 << 20), (1, 1, 1000), (100_000, 1000, 1000), (100_000, 2, 1000), (3, 2, 1 << 20)])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hot, spread, block):
    monkeypatch.setattr(X, "HOT", hot)
    monkeypatch.setattr(X, "SPREAD", spread)
    monkeypatch.setattr(X, "BLOCK", block)
    check(spark, list(enumerate(corpus())))


def test_equal_and_null_ids_are_ordered_by_the_hash_of_the_text(spark):
    docs = [(5, t) for t in corpus()[20:34]] + [(None, corpus()[0]), (2, corpus()[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ranked = df.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()).collect()
    masks = brute.suffix_masks([r["text"] for r in ranked])
    want = [(r["doc_id"], *brute.suffix_digest(*m)) for r, m in zip(ranked, masks)]
    assert sorted(map(tuple, X.removed(df).collect()), key=repr) == sorted(want, key=repr)


def test_texts_without_repeats(spark):
    docs = list(enumerate(corpus()))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("packed", F.lit("p"))
    got = X.without_repeats(df)
    assert got.columns == df.columns
    masks = brute.suffix_masks([t for _, t in docs])
    want = {i: None if t is None else bytes(np.frombuffer(raw, np.uint8)[~m]).decode(errors="ignore") for (i, t), (raw, m) in zip(docs, masks)}
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.removed(none).collect() == [] and X.without_repeats(none).collect() == []


def test_ids_of_any_type(spark):
    text = "the very same passage, long enough to be a repeated string of a hundred bytes and more, word for word, twice over "
    for ids in (["a", "b", "c"], ["a", "b", "b"], ["2024-01-01", None, "x"]):
        docs = spark.createDataFrame(list(zip(ids, [text + "one", text + "two", "short"])), "doc_id string, text string")
        got = sorted(map(tuple, X.removed(docs).select("n_removed", "n_bytes").collect()))
        assert [r[0] > 0 for r in got].count(True) == 1 and len(got) == 3
