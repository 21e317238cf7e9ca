"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables, derives inspection points with the
canonical mapping and applies one operator (or a documented composition).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from ..operators import decide as D
from ..operators import features as FT
from ..operators import forecast as FC
from ..operators import grove
from ..operators import model as M
from ..operators import overrides as O
from ..operators import portfolio as PF
from ..operators import report as P
from ..operators import synth as G
from ..operators import validate as V
from ..operators.metrics import binary_metrics
from ..schema import REQUIRED_POINT_COLUMNS, ForecastB, Validation
from ..scratch import folder, saved
from ..sources import io as IO
from ..sources import profiles
from ..sources.mapping import (
    DEDUP_ORDER,
    load_override_log,
    load_points,
    load_raw,
    nan_points,
    own_forecast_points,
    read_table,
    varied_override_log,
)
from ..streaming import cubes

AS_OF = _dt.date(2002, 1, 1)  # the driver tables' ship dates end in 2001

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


# ----------------------------------------------------------------- forecasts


def _fb(spark, sf_dir):
    return FC.forecast_b(load_points(spark, sf_dir), as_of=AS_OF)


@query("forecast_risk_summary")
def q_forecast_risk_summary(spark, sf_dir):
    return FC.risk_summary(_fb(spark, sf_dir))


@query("forecast_points_b")
def q_forecast_points_b(spark, sf_dir):
    return _fb(spark, sf_dir).select("id_number", *FC.B_OUTPUT)


@query("forecast_points_b_param")
def q_forecast_points_b_param(spark, sf_dir):
    p = ForecastB(minimum_thickness=2.0, safety_factor=2.0, min_interval_months=6, max_interval_months=60)
    return FC.forecast_b(load_points(spark, sf_dir), as_of=AS_OF, profile=p).select(
        "id_number",
        "remaining_life_years",
        "next_inspection_date",
        "recommended_inspection_frequency_months",
        "estimated_thickness_at_next_inspection",
        "risk_level",
    )


@query("forecast_summary")
def q_forecast_summary(spark, sf_dir):
    return FC.forecast_summary(_fb(spark, sf_dir), as_of=AS_OF)


@query("top_priority_inspections")
def q_top_priority(spark, sf_dir):
    return FC.top_priority_inspections(_fb(spark, sf_dir), 10)


@query("inspections_due")
def q_inspections_due(spark, sf_dir):
    return FC.inspections_due(_fb(spark, sf_dir), as_of=AS_OF)


@query("forecast_points_a")
def q_forecast_points_a(spark, sf_dir):
    return FC.forecast_a(load_points(spark, sf_dir), as_of=AS_OF)


@query("forecast_a_rejects")
def q_forecast_a_rejects(spark, sf_dir):
    return FC.forecast_a_rejects(load_points(spark, sf_dir))


@query("risk_distribution_a")
def q_risk_distribution_a(spark, sf_dir):
    return (
        FC.forecast_a(load_points(spark, sf_dir), as_of=AS_OF)
        .groupBy("risk_level")
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min("recommended_inspection_frequency_months").alias("min_months"),
            F.max("recommended_inspection_frequency_months").alias("max_months"),
        )
    )


@query("forecast_risk_by_profile")
def q_forecast_risk_by_profile(spark, sf_dir):
    """Points per risk level under twenty profiles, in one pass."""
    table = FC.profile_table(spark, [(f"p{k:02d}", ForecastB(minimum_thickness=2.0 + k / 10, safety_factor=1.0 + k % 4 / 4,
                                                             min_interval_months=6 + k, max_interval_months=60 + 2 * k)) for k in range(20)])
    fc = FC.forecast_profiles(load_points(spark, sf_dir), table, as_of=AS_OF)
    return fc.groupBy("profile", "risk_level").agg(
        F.count(F.lit(1)).alias("n_points"), F.round(F.avg("remaining_life_years"), 6).alias("avg_remaining_life_years"),
        F.max("recommended_inspection_frequency_months").alias("max_interval_months"))


@query("forecast_points_nan")
def q_forecast_points_nan(spark, sf_dir):
    """NaN measurements give missing forecasts, never the safest ones."""
    return FC.forecast_b(nan_points(load_points(spark, sf_dir)), as_of=AS_OF).select("id_number", *FC.B_OUTPUT)


@query("null_counts_nan")
def q_null_counts_nan(spark, sf_dir):
    return V.null_counts(nan_points(load_points(spark, sf_dir)))


def _own(spark, sf_dir):
    """A forecast of points that bring their own life, date, risk and interval."""
    return FC.forecast_b(own_forecast_points(load_points(spark, sf_dir)), as_of=AS_OF)


for _source in ("forecast", "input"):
    QUERIES[f"forecast_summary_own_{_source}"] = (
        lambda x: lambda spark, sf_dir: FC.forecast_summary(_own(spark, sf_dir), as_of=AS_OF, source=x))(_source)
    QUERIES[f"inspections_due_own_{_source}"] = (
        lambda x: lambda spark, sf_dir: FC.inspections_due(_own(spark, sf_dir), as_of=AS_OF, source=x))(_source)
    QUERIES[f"top_priority_own_{_source}"] = (
        lambda x: lambda spark, sf_dir: FC.top_priority_inspections(_own(spark, sf_dir), 10, source=x))(_source)
    QUERIES[f"forecast_contract_own_{_source}"] = (
        lambda x: lambda spark, sf_dir: V.forecast_contract_split(_own(spark, sf_dir), source=x).select(
            "id_number", "is_valid", "reasons"))(_source)


# ------------------------------------------------------- bands and portfolio


def _pts(spark, sf_dir):
    return load_points(spark, sf_dir)


for _name, _fn in {
    "risk_bands": PF.risk_bands,
    "risk_matrix": PF.risk_matrix,
    "life_histogram": PF.life_histogram,
    "corrosion_by_commodity": PF.corrosion_by_commodity,
    "inspection_priority_points": PF.inspection_priority_points,
    "feature_commodity_hierarchy": PF.feature_commodity_hierarchy,
    "portfolio_health": PF.portfolio_health,
    "life_statistics": PF.life_statistics,
    "corrosion_statistics": PF.corrosion_statistics,
    "thickness_statistics": PF.thickness_statistics,
    "risk_distribution": PF.risk_distribution,
    "inspection_scheduling": PF.inspection_scheduling,
    "commodity_risk": PF.commodity_risk,
    "inspection_timeline": PF.inspection_timeline,
    "report_metrics": PF.report_metrics,
    "advanced_statistics": PF.advanced_statistics,
    "advanced_statistics_flat": PF.advanced_statistics_flat,
    "corrosion_vs_thickness": PF.corrosion_vs_thickness,
}.items():
    QUERIES[_name] = (lambda f: (lambda spark, sf_dir: f(_pts(spark, sf_dir))))(_fn)


@query("risk_matrix_wide")
def q_risk_matrix_wide(spark, sf_dir):
    return PF.risk_matrix_wide(_pts(spark, sf_dir))


@query("advanced_statistics_commodity_risk")
def q_advanced_statistics_commodity_risk(spark, sf_dir):
    """The per-commodity list of A16, as rows."""
    return PF.advanced_statistics(_pts(spark, sf_dir)).select(F.explode("commodity_risk").alias("c")).select("c.*")


def _cube(spark, sf_dir):
    """The cube after two batches of readings; an id's readings are spread over them, and some delete it."""
    target = folder(spark, "cube")
    raw = load_raw(spark, sf_dir).withColumn("removed", F.col("l_returnflag") == "A")
    for i in range(2):
        batch = raw.where(F.pmod(F.xxhash64("l_partkey"), F.lit(2)) == i)
        cubes.apply_readings(batch, i, target, DEDUP_ORDER, newest=False, buckets=4)
    return cubes.cube(spark, target)


for _name, _fn in {
    "incremental_risk_matrix": cubes.risk_matrix,
    "incremental_life_histogram": cubes.life_histogram,
    "incremental_portfolio_health": cubes.portfolio_health,
    "incremental_commodity_risk": cubes.commodity_risk,
}.items():
    QUERIES[_name] = (lambda f: (lambda spark, sf_dir: f(_cube(spark, sf_dir))))(_fn)


# ---------------------------------------------------------------- validation


def _profiled(spark, sf_dir):
    """Profiles of the raw readings, which arrive in two lots of files."""
    lots, base = folder(spark, "profiled-files"), folder(spark, "profiles")
    raw = load_raw(spark, sf_dir).select("l_orderkey", *REQUIRED_POINT_COLUMNS)
    for i in range(2):
        lot = raw.where(F.col("l_orderkey") % 2 == i).drop("l_orderkey")
        lot.write.mode("append").parquet(lots)
        profiles.refresh(spark, lots, base)
    return base


for _name, _fn in {
    "merged_profile": profiles.dataset_profile,
    "merged_duplicate_ids": profiles.duplicate_ids,
    "merged_null_counts": profiles.null_counts,
}.items():
    QUERIES[_name] = (lambda f: (lambda spark, sf_dir: f(spark, _profiled(spark, sf_dir))))(_fn)


@query("duplicate_ids")
def q_duplicate_ids(spark, sf_dir):
    return V.duplicate_ids(load_raw(spark, sf_dir))


@query("null_counts")
def q_null_counts(spark, sf_dir):
    return V.null_counts(load_raw(spark, sf_dir))


@query("corrosion_range_violations")
def q_corrosion_range(spark, sf_dir):
    return V.corrosion_range_violations(load_raw(spark, sf_dir))


@query("corrosion_range_violations_narrow")
def q_corrosion_range_narrow(spark, sf_dir):
    return V.corrosion_range_violations(load_raw(spark, sf_dir), 0.0, 0.30)


@query("thickness_range_violations")
def q_thickness_range(spark, sf_dir):
    return V.thickness_range_violations(load_raw(spark, sf_dir))


@query("thickness_range_violations_narrow")
def q_thickness_range_narrow(spark, sf_dir):
    return V.thickness_range_violations(load_raw(spark, sf_dir), 3.0, 10.0)


@query("dataset_profile")
def q_dataset_profile(spark, sf_dir):
    return V.dataset_profile(load_raw(spark, sf_dir))


@query("commodity_distribution")
def q_commodity_distribution(spark, sf_dir):
    return V.value_distribution(load_raw(spark, sf_dir), "commodity")


@query("feature_type_distribution")
def q_feature_type_distribution(spark, sf_dir):
    return V.value_distribution(load_raw(spark, sf_dir), "feature_type")


@query("row_contract_split")
def q_row_contract_split(spark, sf_dir):
    return V.row_contract_split(load_points(spark, sf_dir)).select("id_number", "is_valid", "reasons")


def _spoilt_points(spark, sf_dir):
    """Points with some values outside the contract, for some ids: rates and thicknesses shifted, shapes and dates spoilt."""
    n = F.conv(F.substring(F.md5("id_number"), 1, 8), 16, 10).cast("long")
    return load_points(spark, sf_dir).withColumns({
        "average_corrosion_rate": F.col("average_corrosion_rate") + F.when(n % 11 == 0, 5.0).when(n % 13 == 0, -1.0).otherwise(0.0),
        "thickness_mm": F.col("thickness_mm") * F.when(n % 17 == 0, 0.0).when(n % 19 == 0, 9.0).otherwise(1.0),
        "cml_shape": F.when(n % 23 == 0, "Spiral").otherwise(F.col("cml_shape")),
        "last_inspection_date": F.when(n % 29 == 0, "soon").otherwise(F.col("last_inspection_date").cast("string")),
    })


@query("contract_report")
def q_contract_report(spark, sf_dir):
    """Every contract of the rule table: points with spoilt values (one pass for three contracts) and the varied override log."""
    rules = contracts.default_rules(spark)
    points = contracts.contract_report(_spoilt_points(spark, sf_dir), rules, "points", "training", "forecast")
    return points.union(contracts.contract_report(varied_override_log(load_raw(spark, sf_dir)), rules, "overrides"))


@query("override_contract_split")
def q_override_contract_split(spark, sf_dir):
    return V.override_contract_split(load_override_log(spark, sf_dir)).select(
        "id_number", "sme_decision", "override_date", "is_valid", "reasons")


@query("override_contract_split_len9")
def q_override_contract_split_len9(spark, sf_dir):
    return V.override_contract_split(load_override_log(spark, sf_dir), Validation(min_reason_len=9)).select(
        "id_number", "sme_decision", "override_date", "is_valid", "reasons")


@query("override_contract_split_varied")
def q_override_contract_split_varied(spark, sf_dir):
    """Every rule of the contract fails for some entries, and some pass."""
    return V.override_contract_split(varied_override_log(load_raw(spark, sf_dir))).select(
        "id_number", "sme_decision", "override_date", "is_valid", "reasons")


@query("row_contract_split_narrow")
def q_row_contract_split_narrow(spark, sf_dir):
    return V.row_contract_split(load_points(spark, sf_dir), Validation(max_rate=0.2, max_thickness=9.0)).select(
        "id_number", "is_valid", "reasons")


@query("domain_check_narrow")
def q_domain_check_narrow(spark, sf_dir):
    return V.domain_check(load_raw(spark, sf_dir), ("Pipe", "Elbow", "Tee"), ("Internal", "External"))


@query("domain_check")
def q_domain_check(spark, sf_dir):
    return V.domain_check(load_raw(spark, sf_dir))


@query("validation_report")
def q_validation_report(spark, sf_dir):
    return V.validation_report(load_raw(spark, sf_dir))


@query("validation_report_narrow")
def q_validation_report_narrow(spark, sf_dir):
    return V.validation_report(load_raw(spark, sf_dir), rate_range=(0.0, 0.30), thickness_range=(3.0, 10.0))


@query("forecast_contract_split")
def q_forecast_contract_split(spark, sf_dir):
    fc = _fb(spark, sf_dir)
    return V.forecast_contract_split(fc).select("id_number", "is_valid", "reasons")


# ------------------------------------------------------------------ features


@query("training_features")
def q_training_features(spark, sf_dir):
    return FT.training_features(load_points(spark, sf_dir), AS_OF).select(
        "id_number", "corrosion_thickness_ratio", "high_corrosion", "thin_wall", "risk_interaction",
        "days_since_inspection")


@query("low_remaining_life")
def q_low_remaining_life(spark, sf_dir):
    points = FT.remaining_life_uncapped(load_points(spark, sf_dir))
    return FT.risk_flags(points).select("id_number", "remaining_life_years", "low_remaining_life")


@query("scoring_features")
def q_scoring_features(spark, sf_dir):
    return FT.scoring_features(load_points(spark, sf_dir), AS_OF)


@query("scoring_features_median_fill")
def q_scoring_features_median(spark, sf_dir):
    return FT.scoring_features(load_points(spark, sf_dir), AS_OF, fill="median")


# ------------------------------------------------- decisions, overrides, report

_BASIC = ("id_number", "elimination_probability", "predicted_elimination_flag", "recommendation", "confidence")


def _basic(spark, sf_dir):
    return D.decide_basic(load_points(spark, sf_dir))


def _enhanced(spark, sf_dir):
    return D.decide_enhanced(load_points(spark, sf_dir))


def _state(spark, sf_dir):
    return O.current_overrides(load_override_log(spark, sf_dir))


@query("decisions_basic")
def q_decisions_basic(spark, sf_dir):
    return _basic(spark, sf_dir).select(*_BASIC)


@query("decisions_enhanced")
def q_decisions_enhanced(spark, sf_dir):
    return _enhanced(spark, sf_dir).select("id_number", "elimination_probability", "predicted_elimination",
                                           "keep_probability", "recommendation", "confidence", "confidence_level")


@query("score_summary")
def q_score_summary(spark, sf_dir):
    return D.score_summary(_enhanced(spark, sf_dir))


@query("limited_results")
def q_limited_results(spark, sf_dir):
    return D.limited_results(_basic(spark, sf_dir).select(*_BASIC), 100)


@query("decision_breakdown")
def q_decision_breakdown(spark, sf_dir):
    return D.decision_breakdown(_basic(spark, sf_dir))


@query("probability_stats")
def q_probability_stats(spark, sf_dir):
    return D.probability_stats(load_points(spark, sf_dir))


@query("top_candidates")
def q_top_candidates(spark, sf_dir):
    return D.top_candidates(_basic(spark, sf_dir), 10)


@query("cost_savings")
def q_cost_savings(spark, sf_dir):
    return D.cost_savings(_basic(spark, sf_dir))


@query("dashboard_decision_counts")
def q_dashboard_decision_counts(spark, sf_dir):
    return PF.dashboard_decision_counts(_basic(spark, sf_dir))


@query("current_overrides")
def q_current_overrides(spark, sf_dir):
    return _state(spark, sf_dir)


@query("get_overrides")
def q_get_overrides(spark, sf_dir):
    weld = load_points(spark, sf_dir).where(F.col("feature_type") == "Weld")
    return O.get_overrides(_state(spark, sf_dir), weld)


@query("remove_overrides")
def q_remove_overrides(spark, sf_dir):
    steam = load_points(spark, sf_dir).where(F.col("commodity") == "Steam")
    return O.remove_overrides(_state(spark, sf_dir), steam)


@query("remove_overrides_logged")
def q_remove_overrides_logged(spark, sf_dir):
    """Removals appended to the log; the state is read from the log alone."""
    steam = load_points(spark, sf_dir).where(F.col("commodity") == "Steam")
    gone = O.removals(steam, _dt.datetime(2002, 1, 1))
    return O.current_overrides(O.upsert_overrides(load_override_log(spark, sf_dir), gone))


@query("apply_overrides")
def q_apply_overrides(spark, sf_dir):
    return O.apply_overrides(_basic(spark, sf_dir), _state(spark, sf_dir)).select(
        "id_number", "recommendation", "has_sme_override", "sme_decision", "sme_reason", "sme_name",
        "sme_override_date", "overridden_decision", "final_decision")


@query("override_statistics")
def q_override_statistics(spark, sf_dir):
    return O.override_statistics(_state(spark, sf_dir))


@query("recent_overrides")
def q_recent_overrides(spark, sf_dir):
    return O.recent_overrides(_state(spark, sf_dir), 10)


@query("overrides_by_sme")
def q_overrides_by_sme(spark, sf_dir):
    return O.overrides_by_sme(_state(spark, sf_dir))


def _scored(spark, sf_dir):
    return P.scored_frame(load_points(spark, sf_dir), _state(spark, sf_dir))


@query("report_summary")
def q_report_summary(spark, sf_dir):
    return P.report_summary(_scored(spark, sf_dir))


@query("report_summary_final")
def q_report_summary_final(spark, sf_dir):
    return P.report_summary(_scored(spark, sf_dir), "final_decision")


@query("confidence_distribution")
def q_confidence_distribution(spark, sf_dir):
    return P.confidence_distribution(_scored(spark, sf_dir))


@query("eliminations_by_commodity")
def q_elim_by_commodity(spark, sf_dir):
    return P.eliminations_by(_scored(spark, sf_dir), "commodity")


@query("eliminations_by_feature")
def q_elim_by_feature(spark, sf_dir):
    return P.eliminations_by(_scored(spark, sf_dir), "feature_type")


@query("top_elimination_candidates")
def q_top_elimination_candidates(spark, sf_dir):
    return P.top_elimination_candidates(_scored(spark, sf_dir), 20)


@query("marginal_cases")
def q_marginal_cases(spark, sf_dir):
    return P.marginal_cases(_scored(spark, sf_dir))


@query("full_report")
def q_full_report(spark, sf_dir):
    return P.report_counts(_scored(spark, sf_dir))


@query("eliminations_by_commodity_final")
def q_elim_by_commodity_final(spark, sf_dir):
    return P.eliminations_by(_scored(spark, sf_dir), "commodity", "final_decision")


@query("eliminations_by_feature_final")
def q_elim_by_feature_final(spark, sf_dir):
    return P.eliminations_by(_scored(spark, sf_dir), "feature_type", "final_decision")


@query("top_candidates_final")
def q_top_candidates_final(spark, sf_dir):
    return P.top_elimination_candidates(_scored(spark, sf_dir), 20, "final_decision")


@query("full_report_final")
def q_full_report_final(spark, sf_dir):
    return P.report_counts(_scored(spark, sf_dir), "final_decision")


# ------------------------------------------------------------ synthetic data


def _synthetic(spark, sf_dir):
    return G.generate_points(
        read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), as_of=AS_OF)


@query("synthetic_points")
def q_synthetic_points(spark, sf_dir):
    return _synthetic(spark, sf_dir)


@query("synthetic_summary")
def q_synthetic_summary(spark, sf_dir):
    return G.dataset_summary(_synthetic(spark, sf_dir))


# -------------------------------------------------------------------- model

TREES = (100, 200, 300)  # forest sizes of the grid search

# Settings of the recorded best model (the basic recipe is the default of M.forest).
FOREST = dict(num_trees=300, max_depth=10, min_instances=2)


def labelled_points(spark, sf_dir):
    """Points that an expert decided on, labelled by the current decision (ELIMINATE is 1)."""
    state = _state(spark, sf_dir).select("id_number", "sme_decision")
    label = F.when(F.col("sme_decision") == "ELIMINATE", 1).otherwise(0)
    return load_points(spark, sf_dir).join(state, "id_number").withColumn(M.LABEL, label).drop("sme_decision")


def _training_table(spark, sf_dir):
    return FT.scoring_features(labelled_points(spark, sf_dir), AS_OF, keep=("id_number", M.LABEL))


_TRAINED: dict = {}


def _input_files(spark, sf_dir):
    """(path, bytes, modification time) of the files that labelled points come from."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def _once(kind, spark, sf_dir, make):
    """A fit's result, kept for the session while its input files stay the same: several queries report on the same model."""
    key, files = (kind, spark.sparkContext.applicationId, sf_dir), _input_files(spark, sf_dir)
    if key not in _TRAINED or _TRAINED[key][0] != files:
        _TRAINED[key] = files, make()
    return _TRAINED[key][1]


def forget_fits():
    """The next query about a model fits it anew."""
    _TRAINED.clear()


def _trained(spark, sf_dir):
    """(model, scored held-out rows, metrics); the held-out rows are a written table."""
    def make():
        model, scored, metrics = M.train_and_evaluate(_training_table(spark, sf_dir), **FOREST)
        return model, scored, metrics

    return _once("forest", spark, sf_dir, make)


def _cross_validated(spark, sf_dir):
    return _once("cv", spark, sf_dir, lambda: M.cross_validated_f1(_training_table(spark, sf_dir), **FOREST))


@query("train_test_split")
def q_train_test_split(spark, sf_dir):
    return M.split_flag(labelled_points(spark, sf_dir)).select("id_number", "elimination_flag", "is_train")


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    return M.fold_column(labelled_points(spark, sf_dir)).select("id_number", "elimination_flag", "fold")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return M.class_weights(labelled_points(spark, sf_dir)).withColumn("class_weight", F.round("class_weight", 6))


@query("additive_risk_labels")
def q_additive_risk_labels(spark, sf_dir):
    """G2 and G3 on given points: additive risk score, and the label rule with a draw from the id."""
    p = load_points(spark, sf_dir).where("average_corrosion_rate IS NOT NULL AND thickness_mm IS NOT NULL")
    rate, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    scored = p.withColumn("_life", F.coalesce(F.try_divide(t - 3.0, rate), F.lit(300.0))).withColumn(
        "risk_score", G.additive_risk_score(rate, t, F.col("_life")))
    u = G.uniform(F.col("id_number"), 42, "label")
    return scored.select("id_number", "risk_score", G.label_rule(rate, t, F.col("risk_score"), u).alias("elimination_flag"))


def _expert_pairs(spark, sf_dir):
    """(label, prediction): expert decision vs the model's decision per overridden point."""
    state = _state(spark, sf_dir).select("id_number", "sme_decision")
    return _basic(spark, sf_dir).join(state, "id_number").select(
        F.when(F.col("sme_decision") == "ELIMINATE", 1).otherwise(0).alias("elimination_flag"),
        F.col("predicted_elimination_flag").alias("prediction"))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return M.classification_report(_expert_pairs(spark, sf_dir))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_expert_pairs(spark, sf_dir))


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    """M7 of the mapped probability against the expert label."""
    state = _state(spark, sf_dir).select("id_number", "sme_decision")
    pairs = load_points(spark, sf_dir).join(state, "id_number").select(
        F.when(F.col("sme_decision") == "ELIMINATE", 1).otherwise(0).alias(M.LABEL), "elimination_probability",
        (F.col("elimination_probability") > 0.5).cast("int").alias("prediction"))
    m = binary_metrics(pairs)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("bootstrap_class_weights")
def q_bootstrap_class_weights(spark, sf_dir):
    """Weights of ``balanced_subsample`` in each tree of the largest forest."""
    w = grove.bootstrap_class_weights(labelled_points(spark, sf_dir), max(TREES))
    return w.withColumn("class_weight", F.round("class_weight", 6))


@query("basic_forest")
def q_basic_forest(spark, sf_dir):
    return M.basic_forest(_training_table(spark, sf_dir))


@query("basic_forest_trees")
def q_basic_forest_trees(spark, sf_dir):
    """A row per tree: its size, depth and what its leaves hold."""
    leaf = F.col("feature").isNull()
    mixed = leaf & (F.col("w0") > 0) & (F.col("w1") > 0)
    return M.basic_forest_trees(_training_table(spark, sf_dir)).groupBy("tree").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(leaf).alias("n_leaves"), F.max("depth").alias("max_depth"),
        F.count_if(mixed).alias("n_mixed_leaves"), F.sum(F.when(leaf, F.col("n_rows"))).alias("n_rows"))


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """The original's 72 settings, five folds of the training rows."""
    table = _training_table(spark, sf_dir)
    train = M.split_flag(table).where("is_train").drop("is_train")
    return M.grid_search(train, trees=TREES)


@query("model_train_evaluate")
def q_model_train_evaluate(spark, sf_dir):
    return _trained(spark, sf_dir)[2]


@query("model_classification_report")
def q_model_classification_report(spark, sf_dir):
    return M.classification_report(_trained(spark, sf_dir)[1])


@query("model_confusion_matrix")
def q_model_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(_trained(spark, sf_dir)[1])


@query("model_scores")
def q_model_scores(spark, sf_dir):
    pts = FT.scoring_features(load_points(spark, sf_dir), AS_OF)
    return M.score_points(_trained(spark, sf_dir)[0], pts).select(
        "id_number", "predicted_elimination_flag", "elimination_probability")


@query("model_feature_importance")
def q_model_feature_importance(spark, sf_dir):
    model, scored, _m = _trained(spark, sf_dir)
    return M.feature_importance(model, scored)


@query("cross_validated_f1")
def q_cross_validated_f1(spark, sf_dir):
    return _cross_validated(spark, sf_dir)


@query("model_metadata")
def q_model_metadata(spark, sf_dir):
    _model, scored, metrics = _trained(spark, sf_dir)
    names = M.numeric_features(_training_table(spark, sf_dir)) + list(M.CATEGORICAL)
    return M.training_record(metrics, scored, _cross_validated(spark, sf_dir), names, **FOREST)


# ---------------------------------------------------------------- sources


@query("dataset_preview")
def q_dataset_preview(spark, sf_dir):
    return IO.dataset_preview(load_points(spark, sf_dir).select(
        "id_number", "average_corrosion_rate", "thickness_mm", "commodity", "feature_type", "cml_shape",
        "last_inspection_date"), 5)
