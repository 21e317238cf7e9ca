"""Collocations against SQL, and against plain counting where the SQL isn't general."""

import collections

import numpy as np
import pytest

from pitwall.llm import phrases

from brute import rows, sql


def frame(spark, data, extra=""):
    return spark.createDataFrame(data, f"doc_id long, text string, lang string{extra}")


def compare(spark, data):
    import pandas as pd

    want = rows(sql(phrases.OP13_SQL, documents=pd.DataFrame(data, columns=["doc_id", "text", "lang"]).astype({"text": "string", "lang": "string"})))
    got = rows(phrases.collocations(frame(spark, data)))
    assert got == want
    return got[1]


def test_query_equals_sql_at_a_thousandth(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    assert rows(phrases.op13_phrases(spark, "/root/testdata/sf0.001")) == rows(con.sql(phrases.OP13_SQL))


def test_edge_cases(spark):
    data = [(1, None, "en"), (2, "", None), (3, "New York, New\tYork! new york\x0cNEW YORK " * 4, None), (4, " . ;", "fr"),
            (5, "a a a a a a a a a a a a a a", "de"), (6, "Ä ö ß " * 12, "de"), (7, "lone", "xx"),
            (8, "the end of the line\n" * 15, "en"), (8, "the end of the line\n" * 15, "en"), (9, "x\xa0y z " * 11, "en")]
    assert len(compare(spark, data)) > 8


def test_cycles_branches_and_long_paths(spark):
    r = np.random.default_rng(3)
    passage = " ".join(f"w{i}" for i in range(2300))  # a path of three rows
    data = [(i, passage, "en") for i in range(11)]
    data += [(20 + i, "p q r s t " * 6, "en") for i in range(3)]  # a cycle
    data += [(40 + i, " ".join(r.choice(list("abcd"), 200)), "en") for i in range(6)]
    compare(spark, data)


def test_empty_table(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []


def test_other_columns_and_parameters(spark):
    docs = frame(spark, [(i, "big data big data", "en", "x", 1) for i in range(3)], ", phrase string, n long")
    got = {(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, min_count=3, covered=101, top=None).collect()}
    assert got == {("big data", 6, 6, 6, 12, 1000000), ("data big", 3, 6, 6, 12, 250000), ("big data big", 3, 6, 6, 12, 250000), ("data big data", 3, 6, 6, 12, 250000)}


def test_arithmetic_past_64_bits(spark):
    f = spark.sql("select cast(3000000000000 as decimal(16,0)) a")
    got = f.selectExpr("(a * a * cast(1000000 as decimal(7,0))) div cast(a * cast(4000000000000 as decimal(16,0)) as decimal(38,0)) s").first().s
    assert got == 750000


@pytest.mark.parametrize("base", [50, 1 << 21])
def test_sums_with_few_and_many_words(base):
    r = np.random.default_rng(base)
    triples = r.integers(0, 12, (500, 3)) * (base // 12 if base > 50 else 1)
    n = r.integers(1, 9, 500)
    want = collections.Counter()
    for t, k in zip(map(tuple, triples.tolist()), n.tolist()):
        want[t] += k
    got, sums = phrases._summed(triples, n, base)
    assert [tuple(t) for t in got.tolist()] == sorted(want) and sums.tolist() == [want[t] for t in sorted(want)]


def test_rows_are_packed_by_node():
    texts = [b"a b c d. a b c e. a b x"] * 3
    names, triples, n = phrases._count(texts)
    buckets = collections.defaultdict(set)
    total = 0
    for bucket, used, local, counts in phrases._packed(names, triples, n, 7):
        used = used.to_pylist()
        for t, k in zip(local.reshape(-1, 3).tolist(), counts.tolist()):
            buckets[tuple(used[x - 1] if x else None for x in t[:2])].add(bucket)
            total += k
    assert total == 33 and all(len(b) == 1 for b in buckets.values())
