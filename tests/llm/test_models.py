import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwall.llm import langid, quality_fm

SF = "/root/testdata/sf0.01"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(50, 4)
    m.w0, m.w, m.v = 0.3, rng.normal(size=50), rng.normal(size=(50, 4))
    index, value = rng.choice(50, 9, replace=False), rng.normal(size=9)
    naive = m.w0 + m.w[index] @ value + sum(m.v[i] @ m.v[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
    got, _ = m.raw(index, value, np.zeros(9, int), 1)
    assert got[0] == pytest.approx(naive)


def test_machine_learns_an_interaction():
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        on = np.flatnonzero(rng.random(6) < 0.5)
        rows.append((on, np.ones(len(on))))
        labels.append(float((0 in on) == (1 in on)))
    m = quality_fm.Machine(6, 4)
    m.v *= 10
    old = quality_fm.EPOCHS
    quality_fm.EPOCHS = 60
    try:
        m.fit(rows, np.array(labels))
    finally:
        quality_fm.EPOCHS = old
    z = np.concatenate([m.raw(i, v, np.zeros(len(i), int), 1)[0] for i, v in rows])
    assert np.mean((z > 0) == np.array(labels)) > 0.95


def test_quality_of_held_out_documents(spark):
    got = quality_fm.op2_quality_fm(spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    m = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    m = m[m.held_out]
    good, bad = m[m.quality == 1].score.values, m[m.quality == 0].score.values
    assert np.mean(good[:, None] > bad[None, :]) > 0.97 and (good >= quality_fm.THRESHOLD).all()


def docs_frame(spark):
    rows = [(1, "good words here", 15), (2, None, None), (3, "", 0), (4, "x " * 30000, -5), (1, "good words here", 15), (None, "no id", 5), (6, "\x00 odd \U0001F600", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("score", F.lit("s"))


def test_quality_edge_rows(spark):
    docs = docs_frame(spark)
    labels = spark.createDataFrame([(1, 1.0), (4, 0.0), (4, 0.0), (3, None), (99, 1.0)], "doc_id long, label double")
    model = quality_fm.train(docs, labels)
    got = [tuple(r) for r in quality_fm.score(docs, model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i == 1}) == 1
    assert {s for _, s in map(tuple, quality_fm.score(docs, quality_fm.train(docs, labels.limit(0))).collect())} == {0.5}
    assert quality_fm.score(docs.limit(0), model).collect() == []


def test_scores_equal_all_pairs(spark):
    """Whole texts, scored by the sum over all pairs of features."""
    docs = docs_frame(spark)
    model = quality_fm.train(docs, spark.createDataFrame([(1, 1.0), (4, 0.0), (2, 0.0), (6, 1.0)], "doc_id long, label double"))
    rng = np.random.default_rng(2)
    model.w0, model.w, model.v = 0.2, rng.normal(0, 0.3, model.w.shape), rng.normal(0, 0.3, model.v.shape)
    want = []
    for r in docs.collect():
        index, value = quality_fm.features(r["text"], r["n_chars"], {})
        pairs = sum(model.v[i] @ model.v[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value), 2))
        want.append((str(r["doc_id"]), 1 / (1 + np.exp(-(model.w0 + model.w[index] @ value + pairs)))))
    got = sorted((str(i), s) for i, s in map(tuple, quality_fm.score(docs, model).collect()))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)]
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(want)], abs=1e-6)


# ---------------------------------------------------------------- languages
def _labelled_by_brute_force(learn, text, langs):
    """(language, score) of a text: counts in plain dictionaries, then every labelling of its words."""
    words_of = lambda t: langid.WORD.findall(t.lower())
    seen = {k: [w for _, t, x in learn if x == k for w in words_of(t)] for k in langs}
    logs, scripts = {}, {}
    for k in langs:
        n = {}
        for g in itertools.chain.from_iterable(langid.grams(w) for w in seen[k]):
            n[g] = n.get(g, 0) + 1
        total = sum(n.values()) + 0.5 * langid.BUCKETS
        logs[k] = lambda g, n=n, total=total: langid.WEIGHT * np.log((n.get(g, 0) + 0.5) / total)
        scripts[k] = {s for s in map(langid.script, seen[k]) if sum(langid.script(w) == s for w in seen[k]) >= langid.MIN_SHARE * len(seen[k])}
    words = words_of(text)
    if not words:
        return "und", 0.0
    may = [[k for k in langs if langid.script(w) in scripts[k]] or langs for w in words]

    def value(path):
        return sum(sum(map(logs[k], langid.grams(w))) for w, k in zip(words, path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

    best = max(itertools.product(*may), key=value)
    letters = {k: sum(len(w) for w, x in zip(words, best) if x == k) for k in langs}
    top = max(langs, key=lambda k: letters[k])
    return top, letters[top] / sum(letters.values())


def test_whole_query_equals_brute_force(spark):
    learn = [(1, "the water flows under the old bridge", "en"), (2, "der schnelle fuchs springt über den hund", "de"), (3, "быстрая лиса прыгает", "ru"),
             (4, "the quick brown fox jumps", "en"), (5, "und dann schläft er ein", "de")]
    texts = ["the old fox", "der alte fuchs", "лиса under the bridge", "the dog schläft dann", "быстрая собака прыгает", "", "12 !", None,
             "den hund лиса the water", "xyz qqq", "ελληνικά the"]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        want = _labelled_by_brute_force(learn, texts[r["doc_id"]] or "", ["de", "en", "ru"])
        assert (r["lang_pred"], r["score"]) == (want[0], pytest.approx(want[1])), texts[r["doc_id"]]


def test_very_many_language_values(spark):
    """The model keeps to its bound; the languages with the most documents are learned."""
    few = spark.range(1000).selectExpr("id AS doc_id", "concat('word', id, ' text') AS text", "concat('x', id) AS lang")
    more = spark.range(1000, 1020).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the water flows', 'der hund schläft') AS text", "if(id % 2 = 0, 'en', 'zz') AS lang")
    model = langid.train(few.unionByName(more))
    assert len(model.langs) == langid.MAX_LANGS and {"en", "zz"} <= set(model.langs)
    got = langid.identify(spark.createDataFrame([(1, "the water"), (2, "der hund schläft"), (3, "word7 text " * 5000)], "doc_id long, text string"), model)
    assert [r["lang_pred"] for r in got.orderBy("doc_id").collect()][:2] == ["en", "zz"]


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (12, 3))
    lengths = np.array([5, 0, 1, 6, 3])
    starts = np.cumsum(lengths) - lengths
    words = rng.integers(0, 12, lengths.sum())
    labels = langid.viterbi(scores, words, starts, lengths, 2.0)
    for s, n in zip(starts, lengths):
        own = words[s : s + n]
        value = lambda p: sum(scores[w, x] for w, x in zip(own, p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(map(value, itertools.product(range(3), repeat=int(n))), default=0)
        assert value(labels[s : s + n].tolist()) == pytest.approx(best)


def test_held_out_languages(spark):
    got = langid.op5_language_spans(spark, SF).toPandas()
    m = got.merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(m) == len(got) and np.mean((m.lang_pred == m.lang)[m.held_out]) > 0.97


def test_spans_of_mixed_texts_scripts_and_edge_rows(spark):
    en = "the water flows under the old bridge and then into the wide valley "
    de = "der schnelle fuchs springt über den faulen hund und schläft danach ein "
    ru = "быстрая лиса прыгает через ленивую собаку и потом спит "
    learn = [(i, t * 3, k) for i, (t, k) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 5)] + [(90, "x", None), (91, None, "en")]
    model = langid.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    rows = [(1, en), (2, en + de + en), (3, ru), (4, None), (5, "12 + 3 !?"), (6, ""), (7, en + ru), (8, "日本語"), (1, en), (None, de), (9, de * 3000), (10, "² ³ ½")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 3, 4, 5, 6, None, 9, 10)] == ["en", "ru", "und", "und", "und", "de", "de", "und"]
    assert [s["lang"] for s in got[2]["spans"]] == ["en", "de", "en"] and [s["lang"] for s in got[7]["spans"]] == ["en", "ru"]
    assert sum(s["words"] for s in got[2]["spans"]) == len((en + de + en).split()) and got[4]["score"] == 0
    assert 0 < got[8]["score"] <= 1
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).collect() == []


def test_rows_that_share_an_id_stay_within_the_limit(spark):
    docs = spark.createDataFrame([(i % 300, f"text number {i}", 12) for i in range(3000)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "doc_id long, label double")
    rows, y = quality_fm.training_rows(docs.repartition(5), labels, 200)
    again, z = quality_fm.training_rows(docs.repartition(3), labels, 200)
    assert len(rows) == len(y) == 200 and all((a[0] == b[0]).all() for a, b in zip(rows, again)) and (y == z).all()
