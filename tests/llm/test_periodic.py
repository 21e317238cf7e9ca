"""Runs of words against a plain scan of every lag."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitwall.llm import periodic


def plain_runs(w, shortest=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        x = q
        while x < len(w):
            if w[x] != w[x - q]:
                x += 1
                continue
            y = x
            while y < len(w) and w[y] == w[y - q]:
                y += 1
            if y - x + q >= max(shortest, 2 * q):
                out.setdefault((x - q, y - x + q), q)
            x = y
    return sorted((s, n, q) for (s, n), q in out.items())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8), st.integers(2, 13))
def test_runs_equal_a_scan_of_every_lag(blocks, shortest):
    w = [x for block, times in blocks for x in block * times]
    assert periodic.runs(np.array(w, np.int64), shortest) == plain_runs(w, shortest)


@pytest.mark.parametrize("w", [[0] * 3000, [0, 1, 2] * 900, ([0] * 40 + [1]) * 60, ([0, 1] * 30 + [0]) * 12, list(range(50)) * 40])
def test_highly_repetitive_texts(w):
    assert periodic.runs(np.array(w)) == plain_runs(w)


def test_a_repeated_word_opens_one_diagonal_however_long():
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def contract(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


TEXTS = [None, "", " \t\n", "one", "buy now " * 30, "a b c d e f g " * 2 + "x " * 11 + "x", "é ü " * 9, "x\x0by\x0cz " * 8,
         " ".join(str(i * i % 97) for i in range(400)), "la " * 4000]


def test_digests_follow_the_contract(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(120)] + [(5, "buy now " * 30)] * 2  # repeated rows, a tenth planted
    got = sorted(tuple(r) for r in periodic.digests(frame(spark, rows), plant=True).collect())
    assert got == sorted(contract(*r) for r in rows)


def test_null_ids_and_empty_tables(spark):
    got = periodic.digests(frame(spark, [(None, "go " * 20)]), plant=True).collect()
    assert [(r.doc_id, r.n_runs, r.period) for r in got] == [(None, 1, 1)]
    for op in (periodic.digests, periodic.find_runs, periodic.collapse):
        assert op(frame(spark, [])).collect() == []


def test_find_and_collapse_keep_other_columns(spark):
    rows = [(1, "start " + "to be or not " * 5 + "end", 7, "kept"), (2, "plain  text", 8, None), (None, None, None, None)]
    docs = frame(spark, rows, ", start long, n_runs string")
    found = periodic.find_runs(docs).collect()
    assert [tuple(r) for r in found] == [(1, 1, 20, 4, "to be or not")]
    out = {r.doc_id: tuple(r) for r in periodic.collapse(docs).collect()}
    assert out == {1: (1, "start to be or not end", 7, "kept"), 2: rows[1], None: rows[2]}


def test_whole_query_against_the_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    docs = [tuple(r) for r in docs]
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [d for d in docs if len(d[1].split()) < 700]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[i] == contract(i, t) for i, t in short)
