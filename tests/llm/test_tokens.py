import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from pitwall.llm import orc_tokens, packing
from pitwall.llm.tokens import Encoder, byte_bpe_path

ODD = [None, "", " ", "  a", "a ", "a  b", "a \n b", "it's  we'll 're", "\n\n", "a\x1c b", "a b c", "<|endoftext|> x", "é" * 50, "日本 語",
       "1 2,3 4", "x" * 5000, " ".join(["pump valve"] * 3000), "tab\tand space", "a\x01b c", "a\u00a0 b", "a\u2003b \u2003", "\x0b\x0c x", "x\ny\nz\n", "\nfirst", "a, b. c.\nD, e", "wait... what, \"so\", ok.", ". a", "x,y. z,", "é, ñ. 1. (a). b", "a., b", "e\u0301, x", "  line", "a\x85 b", "🙂 🙂"]


def corpus(n=150, seed=4):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["alpha", "beta,", "gamma.", "x1", "\nnew"]) for _ in range(r.randint(0, 2500)))) for i in range(n)]


def test_encoder_equals_the_library():
    enc = Encoder(byte_bpe_path())
    texts = ODD + [t for _, t in corpus(20)]
    for _ in range(2):  # the second time from the cache
        got = list(enc.encode(pa.array(texts)))
        assert [x.tolist() for x in got] == [ids[:-1].tolist() for ids in brute.token_ids(texts)]
    assert [x.tolist() for x in enc.encode(pa.array(texts)[5:9])] == [x.tolist() for x in got[5:9]]


@pytest.mark.parametrize("n", [0, 1, 150])
def test_packing_contract(spark, n):
    docs = (corpus(n) + [(1000 + i, t) for i, t in enumerate(ODD)]) if n != 1 else corpus(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    padding, total = brute.check_packing([r.asDict() for r in packing.pack(df).collect()], docs)
    assert padding < packing.SIZE


def test_packing_counts_repeated_rows_each(spark):
    df = spark.createDataFrame([(1, "same text")] * 700 + [(2, None)] * 3, "doc_id long, text string").repartition(4)
    got = packing.pack(df).collect()
    assert sum(r["length"] for r in got) == 700 * len(brute.token_ids(["same text"])[0]) + 3
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack(df.limit(0)).collect() == []


def test_combinations_fill_the_window_and_counts_fit():
    rng = np.random.default_rng(0)
    hist = np.zeros(1024, np.int64)
    np.add.at(hist, rng.integers(1, 1024, 30_000), 1)
    hist[7] = 20_000  # a third of all rests
    combos = packing.combinations(hist)
    assert (combos.sum(axis=1) == 1024).all() and (combos[:, 0] >= combos[:, 1]).all() and (combos[:, 1] >= combos[:, 2]).all()
    x = packing.solve(combos, hist)
    assert (x >= 0).all()
    plan = packing.Plan(hist)
    assert (plan.used <= hist).all()
    seen = {}
    for n in np.flatnonzero(hist):
        for r in {0, 1, int(hist[n]) - 1, int(plan.used[n]) - 1, int(plan.used[n])}:
            if 0 <= r < hist[n]:
                for s, at, k in plan.place(int(n), r):
                    assert seen.setdefault((s, at), (n, r)) == (n, r) and at + k <= 1024


def test_least_squares_reach_an_exact_solution():
    combos = np.array([[600, 424, 0], [512, 512, 0], [500, 424, 100]])
    hist = np.zeros(1024)
    np.add.at(hist, combos.ravel(), np.repeat([30.0, 20.0, 10.0], 3))
    hist[0] = 0
    assert np.abs(packing.solve(combos, hist, rounds=2000) - [30, 20, 10]).max() < 0.01


def test_orc_round_trip(spark, tmp_path):
    docs = corpus(60) + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5000, "twice")] * 2
    path = str(tmp_path / "ids")
    orc_tokens.write(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), path)
    rows = sorted(map(tuple, orc_tokens.digests(spark, path).collect()))
    want, at = [], 0
    for (i, _), ids in zip(docs, brute.token_ids([t for _, t in docs])):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert rows == sorted(want)
    one = orc_tokens.read(spark, path, [7, 9])
    assert sorted(r["doc_id"] for r in one.collect()) == [7, 9]
    assert "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString()
    import pyarrow.orc as orc

    files = [f for f in sorted((tmp_path / "ids").glob("*.orc")) if orc.ORCFile(str(f)).nrows]
    first = [orc.ORCFile(str(f)).read(["doc_id"]).column(0).to_pylist() for f in files]
    assert [x for f in first for x in f] == sorted(i for i, _ in docs)


def test_orc_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    orc_tokens.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert orc_tokens.digests(spark, path).collect() == []
