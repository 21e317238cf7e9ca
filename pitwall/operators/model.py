"""Keep-or-eliminate classifier on Spark ML.

* Preprocessing (M1): median imputation, standard scaling of the numerics,
  one-hot categories with an "unknown" slot that encodes to a zero vector.
* Split and folds (M2, M6): exactly stratified by rank within the label, in the
  order of md5 uniforms of the id; the rank is counted in 65,536 buckets per
  label, so no task ranks a whole label.
* Class weights (M3): per-label counts (one row per class) broadcast back.
* Forest and grid search (M4, M5): Spark's forest up to depth 30, or
  ``grove``'s fully grown one; the preprocessing is fitted, and its vectors are
  cached, once per fold.
* Reports (M7-M11) are aggregations over (label, prediction) pairs.
"""

from __future__ import annotations

import datetime as _dt
import functools
import itertools
import json

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import dbl, literal_rows, zero_filled_counts
from ..scratch import drop_shuffles, saved, shared_dir
from . import grove
from .metrics import binary_metrics, positive_f1
from .synth import uniform

LABEL = "elimination_flag"
CATEGORICAL = ("commodity", "feature_type", "cml_shape")
BASE_NUMERIC = ("average_corrosion_rate", "thickness_mm", "corrosion_thickness_ratio")
OPTIONAL_NUMERIC = ("days_since_inspection", "risk_score", "remaining_life_years")


def numeric_features(df: DataFrame) -> list[str]:
    """M1: the base numerics plus the optional ones the table has."""
    return list(BASE_NUMERIC) + [c for c in OPTIONAL_NUMERIC if c in df.columns]


def preprocessor(numerics, categoricals=CATEGORICAL) -> list:
    """M1 stages: impute -> assemble -> scale numerics; index -> one-hot categories."""
    imp = [f"{c}__imp" for c in numerics]
    idx = [f"{c}__idx" for c in categoricals]
    ohe = [f"{c}__ohe" for c in categoricals]
    return [
        Imputer(inputCols=list(numerics), outputCols=imp, strategy="median"),
        VectorAssembler(inputCols=imp, outputCol="num__vec", handleInvalid="keep"),
        StandardScaler(inputCol="num__vec", outputCol="num__scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=list(categoricals), outputCols=idx, handleInvalid="keep"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, handleInvalid="keep"),
        VectorAssembler(inputCols=["num__scaled", *ohe], outputCol="features"),
    ]


def forest(num_trees: int = 200, max_depth: int = 30, min_instances: int = 1, weight_col: str | None = None,
           seed: int = 42) -> RandomForestClassifier:
    """M4: random forest (depth 30 is Spark's limit, standing in for 'unlimited')."""
    # No node-id cache: it checkpoints a number per row and tree, many times the
    # table.  A larger node budget saves passes over the data for deep forests.
    rf = RandomForestClassifier(featuresCol="features", labelCol=LABEL, numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_instances, seed=seed, maxMemoryInMB=1024, cacheNodeIds=False)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def build_pipeline(df: DataFrame, **forest_args) -> Pipeline:
    return Pipeline(stages=[*preprocessor(numeric_features(df)), forest(**forest_args)])


FIT_PARTS = 8


def fitting_rows(df: DataFrame) -> DataFrame:
    """``df`` in no more parts than the session has cores, or ``FIT_PARTS``: every part ships the statistics of all open
    nodes at each level of the forest, so their volume must not grow with the table's parts."""
    most = max(FIT_PARTS, df.sparkSession.sparkContext.defaultParallelism)
    return df.coalesce(most) if df.rdd.getNumPartitions() > most else df  # a bootstrap follows the parts: few stay as they are


WHOLE_DRAWS = 1 << 28  # rows x trees; Spark's fit keeps a 4-byte count for each
TREES_AT_ONCE = 25


class VoteSum(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Adds up the votes of several forests: the output columns, and the result, of one forest of all their trees."""

    def setInputCols(self, value: list[str]) -> VoteSum:
        return self._set(inputCols=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        each = [vector_to_array(c) for c in self.getInputCols()]
        votes = functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), each)
        out = dataset.withColumn("rawPrediction", array_to_vector(votes)).drop(*self.getInputCols())
        votes = vector_to_array("rawPrediction")
        total = F.aggregate(votes, dbl(0.0), lambda x, y: x + y)
        return out.withColumns({
            "probability": array_to_vector(F.transform(votes, lambda x: x / total)),
            "prediction": (F.array_position(votes, F.array_max(votes)) - 1).cast("double"),  # the first of equals
        })


def fit_model(train: DataFrame, whole: int = WHOLE_DRAWS, **forest_args) -> PipelineModel:
    """``build_pipeline`` fitted on ``train``; above ``whole`` draws in batches of at most ``TREES_AT_ONCE`` trees.

    Spark's forest draws the bootstrap of all trees first and keeps it, 1.2 KB a
    row for 300 trees, many times the table.  A batch keeps its own trees' only.
    """
    one = forest(**forest_args)
    trees = one.getNumTrees()
    if trees <= TREES_AT_ONCE or train.count() * trees <= whole:
        return build_pipeline(train, **forest_args).fit(train)
    prep = Pipeline(stages=preprocessor(numeric_features(train))).fit(train)
    vectors = prep.transform(train).select("features", LABEL, *([one.getWeightCol()] if one.isSet("weightCol") else []))
    n = -(-trees // TREES_AT_ONCE)
    fitted = []
    for i in range(n):
        # seeds far apart: a fit adds the number of the part to its own
        part = one.copy({one.numTrees: trees // n + (i < trees % n), one.seed: one.getSeed() + 1_000_003 * i,
                         one.rawPredictionCol: f"votes_{i}", one.probabilityCol: "", one.predictionCol: ""})
        fitted.append(part.fit(vectors))
        drop_shuffles(train.sparkSession)  # a level's statistics, of every part and open node
    return PipelineModel([*prep.stages, *fitted, VoteSum().setInputCols([f.getRawPredictionCol() for f in fitted])])


RANK_BUCKETS = 65_536


def stratified_rank(df: DataFrame, tag: str, seed: int = 42, key: str = "id_number", label: str = LABEL) -> DataFrame:
    """Add ``_rank`` (0-based, within the label, by md5 uniform then id) and ``_n`` (rows of the label).

    Rows are ranked within (label, leading 16 bits of the uniform); the counts of
    those buckets (at most 65,536 rows per class) give where each begins.
    """
    u = uniform(F.col(key), seed, tag)
    keyed = df.withColumns({"_u": u, "_bucket": F.floor(u * dbl(float(RANK_BUCKETS))).cast("int")})
    counts = keyed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    per = Window.partitionBy("_label")
    begins = counts.select(F.col(label).alias("_label"), F.col("_bucket").alias("_b"), "_c").select(
        "_label", "_b", F.sum("_c").over(per).alias("_n"),
        F.coalesce(F.sum("_c").over(per.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_u", key))
    ranked = keyed.withColumn("_here", here)
    joined = ranked.join(F.broadcast(begins),  # at most RANK_BUCKETS rows per class
                         ranked[label].eqNullSafe(begins["_label"]) & (ranked["_bucket"] == begins["_b"]))
    return joined.withColumn("_rank", F.col("_before") + F.col("_here") - 1).drop("_u", "_bucket", "_label", "_b", "_before", "_here")


def split_flag(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, key: str = "id_number", label: str = LABEL) -> DataFrame:
    """M2: ``is_train``; the test rows of each label are its first round(n * test_fraction) ranks."""
    ranked = stratified_rank(df, "split", seed, key, label)
    return ranked.withColumn("is_train", F.col("_rank") >= F.round(F.col("_n") * dbl(test_fraction))).drop("_rank", "_n")


def fold_column(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id_number", label: str = LABEL) -> DataFrame:
    """M6: fold 0..k-1, in turn by rank, so each label's folds differ by at most one row."""
    return stratified_rank(df, "fold", seed, key, label).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_n")


def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M3: 'balanced' weights n / (k * n_class), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    w = Window.partitionBy()  # over the per-class rows only (k rows)
    return counts.select(
        label, "n_class",
        (F.sum("n_class").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_class"))).alias("class_weight"),
    )


def with_class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Attach the per-class weight (the class table has one row per class: a proven bound)."""
    return df.join(F.broadcast(class_weights(df, label).select(label, "class_weight")), label, "left")


def _fold_vectors(train: DataFrame, k: int, seed: int):
    """For each fold: (fitting vectors, held-out vectors), preprocessed once and cached; unpersisted afterwards."""
    train = saved(train, "points")  # ranks, their counts and class weights each read them
    data = with_class_weights(fold_column(train, k, seed)).persist()
    stages = preprocessor(numeric_features(train))
    try:
        for i in range(k):
            prep = Pipeline(stages=stages).fit(data.where(F.col("fold") != i))
            vectors = prep.transform(data).select("id_number", "fold", LABEL, "class_weight", "features").persist()
            try:
                yield i, vectors.where(F.col("fold") != i), vectors.where(F.col("fold") == i)
            finally:
                vectors.unpersist()
    finally:
        data.unpersist()


def grid_search(train: DataFrame, k: int = 5, seed: int = 42, trees=(100, 200, 300), depths=(10, 20, None), splits=(2, 5),
                leaves=(1, 2), weightings=("balanced", "balanced_subsample"), bound: int = grove.BOUND) -> DataFrame:
    """M5: mean positive-class F1 over k stratified folds of every setting, best first (72 settings by default).

    Each fold needs a forest per (leaf, weighting) only, grown once at the
    largest size: the settings that differ in trees, depth (None: unlimited) or
    split threshold are read off it.  ``max_depth`` is null where unlimited;
    ``f1`` holds the folds' scores.
    """
    spark = train.sparkSession
    shared_dir(spark)
    fits = [grove.Fit(min_leaf=leaf, weighting=w) for leaf, w in itertools.product(leaves, weightings)]
    nested = list(itertools.product(sorted(trees), depths, splits))
    scores: dict[tuple, list[float]] = {}
    for i, fit, held in _fold_vectors(train, k, seed):
        rows = grove.rows_of(fit.union(held), F.col("fold") == i, seed=seed)
        votes = grove.held_out_chances(rows, fits, sorted(trees), depths, splits, seed, bound)
        guess = F.round("v", 9) > 0.5
        cells = votes.select("fit", "y", F.posexplode("p").alias("setting", "v")).groupBy("fit", "setting").agg(
            F.count_if((F.col("y") == 1) & guess).alias("hit"), F.count_if((F.col("y") == 1) | guess).alias("any"))
        for c in cells.collect():  # a row per setting
            key = (*nested[c.setting], fits[c.fit].min_leaf, fits[c.fit].weighting)
            scores.setdefault(key, []).append(2 * c.hit / (c.hit + c.any) if c.any else 0.0)
    rows = [(*key, f, sum(f) / k) for key, f in scores.items()]
    return spark.createDataFrame(
        rows, "num_trees int, max_depth int, min_split int, min_leaf int, weighting string, f1 array<double>, cv_f1 double").orderBy(
        F.col("cv_f1").desc(), "num_trees", F.col("max_depth").asc_nulls_last(), "min_split", "min_leaf", "weighting")


def _split_vectors(points: DataFrame, test_fraction: float, seed: int) -> DataFrame:
    """Vectors of the points with ``is_train``, preprocessed by the training rows.

    The points are written, because ranks and their counts each read them, and so
    is the split table: every step of the preprocessing reads it.
    """
    data = saved(split_flag(saved(points, "points"), test_fraction, seed), "split")
    prep = Pipeline(stages=preprocessor(numeric_features(points))).fit(data.where(F.col("is_train")))
    return prep.transform(data).select("id_number", LABEL, "is_train", "features")


def basic_forest(points: DataFrame, num_trees: int = 200, test_fraction: float = 0.2, seed: int = 42, fit: grove.Fit = grove.Fit(),
                 bound: int = grove.BOUND) -> DataFrame:
    """M4: the basic recipe, trees of unlimited depth: (id_number, label, elimination_probability, prediction) of the test rows."""
    rows = grove.rows_of(_split_vectors(points, test_fraction, seed), ~F.col("is_train"), seed=seed)
    votes = grove.held_out_chances(rows, [fit], (num_trees,), (None,), (2,), seed, bound)
    chance = F.round(F.col("p")[0], 9)
    return votes.select(F.col("id").alias("id_number"), F.col("y").alias(LABEL), chance.alias("elimination_probability"),
                        (chance > 0.5).cast("int").alias("prediction"))


def basic_forest_trees(points: DataFrame, num_trees: int = 200, test_fraction: float = 0.2, seed: int = 42, fit: grove.Fit = grove.Fit(),
                       bound: int = grove.BOUND) -> DataFrame:
    """M4: the grown nodes of the basic recipe's trees (``grove.trees_of``)."""
    rows = grove.rows_of(_split_vectors(points, test_fraction, seed).where("is_train"), F.lit(False), seed=seed)
    return grove.trees_of(rows, fit, num_trees, seed, bound)


def score_points(model: PipelineModel, df: DataFrame, threshold_col: str = "predicted_elimination_flag") -> DataFrame:
    """Class and elimination probability per row."""
    out = model.transform(df)
    return out.withColumns({
        threshold_col: F.col("prediction").cast("int"),
        "elimination_probability": vector_to_array(F.col("probability"))[1],
    })


def test_metrics(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """M7: accuracy, ROC-AUC and positive-class F1 as one row."""
    return binary_metrics(scored.withColumn("_p", vector_to_array("probability")[1]), label, "_p")


def classification_report(pairs: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """M8: per-class precision / recall / F1 / support plus macro and weighted averages.

    Built from the (label, prediction) cell counts; each cell contributes to
    its label's tp / fn and its prediction's fp, so no join of classes is needed.
    """
    cells = pairs.groupBy(F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    contrib = cells.select(F.explode(F.array(
        F.struct(F.col("l").alias("cls"), F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"),
                 F.when(F.col("l") != F.col("p"), F.col("n")).otherwise(0).alias("fn"), F.col("n").alias("support")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("l") != F.col("p"), F.col("n")).otherwise(0).alias("fp"),
                 F.lit(0).cast("bigint").alias("fn"), F.lit(0).cast("bigint").alias("support")),
    )).alias("c")).select("c.*")
    per = contrib.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(dbl(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(dbl(0.0))
    per = per.select(F.col("cls").cast("string").alias("class_name"), prec.alias("precision"),
                     rec.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      dbl(2.0) * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(dbl(0.0)))
    tot = F.sum("support")
    # One row per class: collected into one array, and the averages taken over it.
    one = per.agg(
        F.collect_list(F.struct("class_name", "precision", "recall", "f1", "support")).alias("rows"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("wf"),
        (F.sum("tp") / tot).alias("acc"), tot.alias("n"),
    )

    def line(name, precision, recall, f1):
        return F.struct(F.lit(name).alias("class_name"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), F.col("n").alias("support"))

    averages = F.array(
        line("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        line("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")),
        line("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), F.col("acc")),
    )
    out = one.where(F.col("n") > 0).select(F.explode(F.concat("rows", averages)).alias("r")).select("r.*")
    return out.select("class_name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def confusion_matrix(pairs: DataFrame, label: str = LABEL, prediction: str = "prediction",
                     classes=(0, 1)) -> DataFrame:
    """M9: label x prediction counts, zero-filled over the fixed class list."""
    spark = pairs.sparkSession
    keyed = pairs.select(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction"))
    dim = literal_rows(spark, [(a, b) for a in classes for b in classes], "label int, prediction int")
    return zero_filled_counts(keyed, dim, ["label", "prediction"], count_name="n")


def cross_validated_f1(data: DataFrame, k: int = 5, seed: int = 42, num_trees: int = 200, max_depth: int | None = None,
                       min_instances: int = 1, weighting: str | None = "balanced", bound: int = grove.BOUND) -> DataFrame:
    """Positive-class F1 per stratified fold (weighted fit on the other folds), plus mean and population std."""
    spark = data.sparkSession
    shared_dir(spark)
    fit = grove.Fit(min_instances, weighting, max_depth)
    rows = []
    for i, rest, held in _fold_vectors(data, k, seed):
        given = grove.rows_of(rest.union(held), F.col("fold") == i, seed=seed)
        chance = grove.held_out_chances(given, [fit], (num_trees,), (None,), (2,), seed, bound)
        f1 = positive_f1(chance.select("y", (F.round(F.col("p")[0], 9) > 0.5).cast("int").alias("g")), "y", "g")
        rows.append((i, f1.select("f1_score").first()[0]))
    scores = spark.createDataFrame(rows, "fold int, f1 double")
    every = Window.partitionBy()  # over the k rows
    return scores.withColumns({"cv_f1_mean": F.avg("f1").over(every), "cv_f1_std": F.stddev_pop("f1").over(every)})


def training_record(metrics: DataFrame, held_out: DataFrame, cv: DataFrame, feature_names: list[str], **settings) -> DataFrame:
    """One row with test metrics, confusion matrix, cross-validation mean and std, settings and features.

    ``metrics``, ``cv`` and the confusion matrix have a few rows each.
    """
    matrix = confusion_matrix(held_out).agg(F.sort_array(F.collect_list(F.struct("label", "prediction", "n")))).scalar()
    fold = cv.agg(F.struct(F.max("cv_f1_mean").alias("mean"), F.max("cv_f1_std").alias("std"))).scalar()
    return metrics.select(
        "*", matrix.alias("confusion_matrix"), fold["mean"].alias("cv_f1_mean"), fold["std"].alias("cv_f1_std"),
        F.array(*[F.lit(n) for n in feature_names]).alias("feature_names"),
        F.lit(json.dumps(settings, sort_keys=True)).alias("settings"))


def feature_importance(model: PipelineModel, scored: DataFrame, top: int = 10) -> DataFrame:
    """Forest importances with expanded feature names, largest first."""
    spark = scored.sparkSession
    forests = [s for s in model.stages if isinstance(s, RandomForestClassificationModel)]
    meta = scored.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {}
    for group in meta.values():
        for a in group:
            names[a["idx"]] = a["name"]
    if len(forests) == 1:
        imps = forests[0].featureImportances.toArray()
    else:  # a forest's are the mean of its trees that split
        imps = sum(f.featureImportances.toArray() * sum(t.numNodes > 1 for t in f.trees) for f in forests)
        imps = imps / (imps.sum() or 1.0)
    rows = [(names.get(i, f"f{i}"), float(v)) for i, v in enumerate(imps)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), F.col("feature")).limit(top)


def save_model(model: PipelineModel, model_dir: str, metrics: dict, feature_names: list[str],
               timestamp: str | None = None) -> str:
    """An immutable version with its metadata record, then the pointer that ``load_model`` follows for 'latest'.

    A crash before the pointer is replaced leaves the model before as the latest.
    """
    from ..sources import catalogue

    ts = timestamp or _dt.datetime.now().strftime("%Y%m%d_%H%M%S")
    base = model_dir.rstrip("/")
    path = catalogue.version_path(base, f"model_{ts}")
    model.write().overwrite().save(path)
    meta = {"timestamp": ts, "feature_names": feature_names, "metrics": metrics, "model_path": path}
    spark = _active_spark()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/model_metadata_{ts}")
    catalogue.point(spark, base, f"model_{ts}")
    return path


def load_model(path: str) -> PipelineModel:
    """The model of a version's path, or ``<model_dir>/latest``: the committed one."""
    from ..sources import catalogue

    base, _, name = path.rstrip("/").rpartition("/")
    if name == "latest":
        version = catalogue.current(_active_spark(), base)
        if version is None:
            raise FileNotFoundError(f"no model is committed in {base}")
        path = catalogue.version_path(base, version)
    return PipelineModel.load(path)


def _active_spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def train_and_evaluate(points: DataFrame, test_fraction: float = 0.2, seed: int = 42, balanced: bool = True,
                       whole: int = WHOLE_DRAWS, **forest_args):
    """Train on the split's train rows, evaluate on its test rows.

    Returns (model, scored_test, metrics_df).  The points are written, because
    the ranks, their counts and the class weights each read them, and the split
    table is persisted, because the forest makes several passes over it.
    """
    points = saved(points, "points")
    drop_shuffles(points.sparkSession)  # of the points' own making
    data = split_flag(points, test_fraction, seed)
    if balanced:
        data = with_class_weights(data)
        forest_args.setdefault("weight_col", "class_weight")
    data = data.persist()
    try:
        # the copy has no training summary: that holds the session, which can't be sent to tasks once a frame was observed
        model = fit_model(fitting_rows(data.where(F.col("is_train"))), whole, **forest_args).copy()
        scored = saved(model.transform(data.where(~F.col("is_train"))), "held-out")  # every report reads it
        metrics = test_metrics(scored)
    finally:
        data.unpersist()
    return model, scored, metrics
