import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.llm import simhash as S


def test_the_code_covers_within_three_bits():
    a = S.Anchors()
    y = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    home = a.home(y)
    assert (np.bitwise_count(home ^ y) <= 3).all()
    assert (a.home(home) == home).all()
    row, anchor = a.near(y, 22)
    assert set(zip(row.tolist(), anchor.tolist())) >= {(i, int(a.home(np.array([v ^ 1 << 5]))[0])) for i, v in enumerate(y.tolist())}


def test_fingerprints_within_the_threshold_meet():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000).astype(np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)
    key, role, fp = S.place(np.r_[x, y], S.Anchors())
    left, right = {}, {}
    for k, r, f in zip(key.tolist(), role.tolist(), fp.tolist()):
        (right if r else left).setdefault(k, set()).add(f)
    met = {(a, b) for k in left for a in left[k] for b in right.get(k, ())}
    assert all((a, b) in met for a, b in zip(x.tolist(), y.tolist()))


@pytest.mark.parametrize("small", [0, 256])
def test_links_of_groups(monkeypatch, small):
    monkeypatch.setattr(S, "SMALL", small)
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(30), rng.integers(1, 40, 30))
    role = rng.integers(0, 2, len(group)).astype(np.int32)
    order = np.lexsort((role, group))
    fps = rng.integers(0, 1 << 6, len(group)).astype(np.uint64)
    got = S.links(group[order], role[order], fps[order])
    assert all(bin(int(a) ^ int(b)).count("1") <= 3 for a, b in got)


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    base = [[word() for _ in range(r.randint(3, 150))] for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base[:12]:
        for _ in range(r.randint(1, 6)):
            c = list(b)
            c[r.randrange(len(c))] = word()
            out.append(r.choice([" ", "\n", "\t "]).join(c).upper())
    return out + out[:4] + [None, "", "  ", "one", "ONE", "two words"]


@pytest.mark.parametrize("hot", [1, 20_000])
def test_components_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_ROWS", hot)
    docs = [(i * 3 + 1, t) for i, t in enumerate(corpus())] + [(None, "one"), (1, "another text of id one"), (1, "another text of id one")]
    got = S.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.simhash_classes(docs), key=repr)


def test_one_of_each(spark):
    docs = [(i + 1, t) for i, t in enumerate(corpus())] + [(1, corpus()[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("key", F.lit(1))
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute.simhash_classes(docs)})


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(none).collect() == [] and S.one_of_each(none).collect() == []


def test_text_ids_and_reserved_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([("b", text, "own"), ("a", text, "own"), ("c", "x " * 30_000, "own")], "doc_id string, text string, _s_text string")
    assert sorted(map(tuple, S.one_of_each(docs).select("doc_id", "_s_text").collect())) == [("a", "own"), ("c", "own")]
    assert {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()} == {"a": "a", "b": "a", "c": "c"}
