import datetime as dt
import gc
import threading
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pitwall.operators import features as FT
from pitwall.operators import model as M
from pitwall.operators import synth as G

AS_OF = dt.date(2002, 1, 1)
SMALL = dict(num_trees=10, max_depth=5, min_instances=1)


@pytest.fixture(scope="module")
def table(spark):
    pts = G.generate_range(spark, 600, as_of=AS_OF, seed=7)
    return FT.scoring_features(pts, AS_OF, keep=("id_number", "elimination_flag")).cache()


def test_synthetic_generator(spark):
    pts = G.generate_range(spark, 300, as_of=AS_OF, seed=1)
    s = G.dataset_summary(pts).first()
    assert s.total_records == 300 and s.unique_commodities == 9 and s.unique_feature_types == 9
    assert 0.02 <= s.min_rate and s.max_rate <= 0.25 and 6.0 <= s.min_thickness and s.max_thickness <= 12.0
    assert s.max_risk_score <= 100
    again = G.generate_range(spark, 300, as_of=AS_OF, seed=1).repartition(7)
    assert sorted(map(tuple, pts.collect())) == sorted(map(tuple, again.collect()))  # partition-independent


def test_split_folds_weights(table):
    split = M.split_flag(table)
    for label in (0, 1):
        own = split.where(F.col("elimination_flag") == label)
        assert own.where(~F.col("is_train")).count() == round(own.count() * 0.2)
    folds = M.fold_column(table).groupBy("elimination_flag", "fold").count().collect()
    for label in (0, 1):
        sizes = [r["count"] for r in folds if r.elimination_flag == label]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    w = {r.elimination_flag: (r.n_class, r.class_weight) for r in M.class_weights(table).collect()}
    n = sum(v[0] for v in w.values())
    for n_c, wt in w.values():
        assert wt == pytest.approx(n / (2 * n_c))


def test_train_score_save_load(spark, table, scratch):
    spark.range(3).observe(Observation("rows"), F.count("id")).collect()  # as publishing does
    model, scored, metrics = M.train_and_evaluate(table, **SMALL)
    m = metrics.first()
    assert 0 <= m.test_accuracy <= 1 and 0 <= m.roc_auc <= 1 and 0 <= m.f1_score <= 1
    unseen = table.limit(5).withColumn("commodity", F.lit("Liquid Helium"))
    out = M.score_points(model, unseen).collect()
    assert len(out) == 5 and all(0 <= r.elimination_probability <= 1 for r in out)
    path = M.save_model(model, f"{scratch}/models", {"f1": m.f1_score}, M.numeric_features(table),
                        timestamp="20250101_000000")
    again = M.load_model(path)
    a = [r.elimination_probability for r in M.score_points(model, table.limit(20)).orderBy("id_number").collect()]
    b = [r.elimination_probability for r in M.score_points(again, table.limit(20)).orderBy("id_number").collect()]
    assert a == b
    imp = M.feature_importance(model, scored).collect()
    assert 1 <= len(imp) <= 10 and imp[0].importance >= imp[-1].importance


def test_reports_from_pairs(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "elimination_flag int, prediction int")
    rep = {r.class_name: r for r in M.classification_report(pairs).collect()}
    assert rep["1"].precision == 0.5 and rep["1"].recall == 0.5 and rep["1"].support == 2
    assert rep["0"].recall == pytest.approx(2 / 3, abs=1e-6)
    assert rep["accuracy"].f1 == 0.6
    cm = {(r.label, r.prediction): r.n for r in M.confusion_matrix(pairs).collect()}
    assert cm == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}


def test_the_fit_checkpoints_nothing_and_has_few_parts(spark):
    assert not M.forest().getCacheNodeIds()
    most = max(M.FIT_PARTS, spark.sparkContext.defaultParallelism)
    assert M.fitting_rows(spark.range(0, 500, 1, 3 * most)).rdd.getNumPartitions() <= most
    assert M.fitting_rows(spark.range(0, 500, 1, 5)).rdd.getNumPartitions() == 5


def test_a_large_fit_keeps_the_draws_of_few_trees(spark, table, scratch, monkeypatch):
    monkeypatch.setattr(M, "TREES_AT_ONCE", 4)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = table.withColumn("thickness_mm", counted("thickness_mm"))
    model, scored, metrics = M.train_and_evaluate(rows, whole=1000, **SMALL)
    assert seen.value == table.count()  # the points are computed once
    forests = [s for s in model.stages if hasattr(s, "getNumTrees")]
    assert [f.getNumTrees for f in forests] == [4, 3, 3]
    trees = [t for f in forests for t in f.trees]
    assert len({t.toDebugString.partition("\n")[2] for t in trees}) == 10
    for r in scored.limit(20).collect():  # as one forest of the ten trees
        p = sum(t.predictProbability(r.features).toArray() for t in trees) / 10
        assert r.probability.toArray() == pytest.approx(p) and r.rawPrediction.toArray() == pytest.approx(10 * p)
        assert r.prediction == p.argmax()
    assert set(scored.columns) == set(M.train_and_evaluate(table, **SMALL)[1].columns)
    assert 0.5 < metrics.first().roc_auc <= 1
    mean = sum(t.featureImportances.toArray() for t in trees) / 10
    top = M.feature_importance(model, scored, 3).collect()
    assert [r.importance for r in top] == pytest.approx(sorted(mean, reverse=True)[:3])
    again = M.load_model(M.save_model(model, f"{scratch}/batches", {}, M.numeric_features(table), timestamp="1"))
    chances = lambda m: [r[2] for r in M.score_points(m, table.limit(20)).select(
        "id_number", "predicted_elimination_flag", "elimination_probability").orderBy("id_number").collect()]
    assert chances(model) == chances(again)


def _shuffle_files(spark):
    gc.collect()
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def test_a_large_fit_leaves_no_shuffles_of_a_batch(spark, table, monkeypatch):
    monkeypatch.setattr(M, "TREES_AT_ONCE", 4)
    drop, left = M.drop_shuffles, []

    def watched(session):
        before = _shuffle_files(session)
        drop(session)
        until = time.time() + 20
        while before and before <= _shuffle_files(session) and time.time() < until:  # Spark's cleaner is a thread of its own
            time.sleep(0.1)
        left.append(len(before - _shuffle_files(session)))

    monkeypatch.setattr(M, "drop_shuffles", watched)
    M.train_and_evaluate(table, whole=1000, **SMALL)
    assert len(left) == 4 and all(left[1:])  # after the points and each of three batches


def test_shuffles_that_are_held_a_moment_longer_are_dropped(spark):
    before = _shuffle_files(spark)
    held = [spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count().rdd._jrdd]
    held[0].count()
    mine = _shuffle_files(spark) - before
    assert mine
    threading.Timer(0.15, held.clear).start()
    M.drop_shuffles(spark)
    until = time.time() + 10  # no garbage is collected any more; the cleaner is a thread of its own
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    while mine & files() and time.time() < until:
        time.sleep(0.1)
    assert not mine & files()


def test_the_fit_has_as_many_parts_as_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert M.fitting_rows(spark.range(0, 500, 1, 24 + cores)).rdd.getNumPartitions() == max(8, cores)


def _times_read(spark, make):
    """Times that each row of a table is computed while ``make`` works on it."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = make(lambda t: t.withColumn("thickness_mm", counted("thickness_mm")))
    return seen.value / rows


def test_grown_forests_read_their_points_once(spark, table):
    def split(count):
        M._split_vectors(count(table), 0.2, 42).collect()
        return table.count()

    def folds(count):
        for _ in M._fold_vectors(count(table), 2, 42):
            pass
        return table.count()

    assert _times_read(spark, split) == 1 and _times_read(spark, folds) == 1


def test_cross_validated_f1(table):
    cv = M.cross_validated_f1(table, k=3, **SMALL).collect()
    assert len(cv) == 3 and all(0 <= r.f1 <= 1 for r in cv)


def test_grid_search_small(table):
    rows = M.grid_search(table, k=2, trees=(5, 10), depths=(3, None), leaves=(1,), splits=(2, 9)).collect()
    assert len(rows) == 16 and all(0 <= r.cv_f1 <= 1 and len(r.f1) == 2 for r in rows)
    assert [r.cv_f1 for r in rows] == sorted((r.cv_f1 for r in rows), reverse=True)


def test_training_record(table):
    _model, scored, metrics = M.train_and_evaluate(table, **SMALL)
    r = M.training_record(metrics, scored, M.cross_validated_f1(table, k=2, **SMALL), M.numeric_features(table), **SMALL).first()
    assert sum(c.n for c in r.confusion_matrix) == scored.count() and 0 <= r.cv_f1_mean <= 1 and "num_trees" in r.settings


def test_reports_of_no_pairs(spark):
    none = spark.createDataFrame([], "elimination_flag int, prediction int")
    assert M.classification_report(none).collect() == []
    assert [r.n for r in M.confusion_matrix(none).collect()] == [0, 0, 0, 0]
