import datetime as dt

import pytest

from pitwall.operators import decide as D
from pitwall.operators import overrides as O
from pitwall.operators import report as P


def _probs(spark, ps):
    return spark.createDataFrame([(f"P{i}", float(p)) for i, p in enumerate(ps)],
                                 "id_number string, elimination_probability double")


def test_probability_edges(spark):
    df = _probs(spark, [0.4, 0.5, 0.6, 0.8, 0.2, 0.81])
    b = {r.id_number: r for r in D.decide_basic(df).collect()}
    assert b["P1"].recommendation == "KEEP"  # 0.5 keeps
    assert b["P2"].recommendation == "ELIMINATE"
    assert b["P3"].confidence == "HIGH"  # abs(0.8-0.5) > 0.3 in doubles
    e = {r.id_number: r for r in D.decide_enhanced(df).collect()}
    assert e["P3"].confidence_level == "MEDIUM"  # max(p, 1-p) = 0.8 is not > 0.8
    assert e["P5"].confidence_level == "HIGH"
    assert e["P0"].confidence_level == "LOW" and e["P0"].confidence == pytest.approx(0.6)
    m = {r.id_number for r in P.marginal_cases(D.decide_basic(df)).collect()}
    assert m == {"P1"}  # both bounds strict


def test_summaries(spark):
    df = D.decide_basic(_probs(spark, [0.1, 0.9, 0.95, 0.3]))
    c = D.cost_savings(df).first()
    assert (c.eliminated_cmls, c.annual_savings, c.savings_5_years, c.savings_10_years) == (2, 2000, 10000, 20000)
    br = {(r.dimension, r.value): r.pct for r in D.decision_breakdown(df).collect()}
    assert br[("recommendation", "ELIMINATE")] == 50.0
    lim = D.limited_results(df, 2).collect()
    assert [r.id_number for r in lim] == ["P0", "P1"] and lim[0].total_results == 4


LOG_SCHEMA = ("id_number string, sme_decision string, reason string, sme_name string, override_date timestamp_ntz, "
              "original_prediction string, original_probability double")


def _log(spark):
    t = dt.datetime
    return spark.createDataFrame([
        ("A", "KEEP", "first opinion here", "ann", t(2024, 1, 1), "ELIMINATE", 0.7),
        ("A", "ELIMINATE", "second opinion here", "bob", t(2024, 2, 1), "ELIMINATE", 0.7),
        ("B", "KEEP", "kept for monitoring", "ann", t(2024, 1, 5), None, None),
        ("UNKNOWN", "KEEP", "no such point here", "cy", t(2024, 1, 6), "KEEP", 0.1),
    ], LOG_SCHEMA)


def test_current_state_and_stats(spark):
    state = O.current_overrides(_log(spark))
    cur = {r.id_number: r for r in state.collect()}
    assert cur["A"].sme_decision == "ELIMINATE" and cur["A"].sme_name == "bob"
    s = O.override_statistics(state).first()
    assert (s.total_overrides, s.keep_overrides, s.eliminate_overrides) == (3, 2, 1)
    assert s.disagreements_with_ml == 1  # the missing original prediction counts
    assert s.agreement_rate == pytest.approx(66.7)
    recent = O.recent_overrides(state, 2).collect()
    assert [r.id_number for r in recent] == ["A", "UNKNOWN"]
    assert {r.sme_name: r.n_overrides for r in O.overrides_by_sme(state).collect()} == {"bob": 1, "ann": 1, "cy": 1}


def test_empty_stats(spark):
    s = O.override_statistics(spark.createDataFrame([], LOG_SCHEMA)).first()
    assert (s.total_overrides, s.keep_overrides, s.eliminate_overrides) == (0, 0, 0)
    assert s.agreement_rate is None


def test_apply_and_idempotence(spark):
    state = O.current_overrides(_log(spark))
    scored = D.decide_basic(spark.createDataFrame([("A", 0.1), ("B", 0.9), ("C", 0.9)],
                                                  "id_number string, elimination_probability double"))
    out = {r.id_number: r for r in O.apply_overrides(scored, state).collect()}
    assert out["A"].final_decision == "ELIMINATE" and out["A"].has_sme_override
    assert out["B"].final_decision == "KEEP"
    assert out["C"].final_decision == "ELIMINATE" and not out["C"].has_sme_override
    assert out["C"].overridden_decision is None
    twice = O.current_overrides(O.upsert_overrides(_log(spark), _log(spark)))
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, state.collect()))
    ids = spark.createDataFrame([("A",)], "id_number string")
    assert {r.id_number for r in O.get_overrides(state, ids).collect()} == {"A"}
    assert {r.id_number for r in O.remove_overrides(state, ids).collect()} == {"B", "UNKNOWN"}


def test_new_override_validates(spark):
    with pytest.raises(ValueError):
        O.new_override(spark, "A", "MAYBE", "reason text long", "x")
    row = O.new_override(spark, "A", "KEEP", "reason text long", "x").first()
    assert row.sme_decision == "KEEP" and row.override_date is not None


def test_report(spark):
    points = spark.createDataFrame([("A", 0.9, "Gas", "Pipe", 0.1, 9.0), ("B", 0.45, "Gas", "Tee", 0.2, 8.0),
                                    ("C", 0.2, "Steam", "Pipe", 0.3, 7.0)],
                                   "id_number string, elimination_probability double, commodity string, "
                                   "feature_type string, average_corrosion_rate double, thickness_mm double")
    state = O.current_overrides(_log(spark))
    scored = P.scored_frame(points, state)
    s = P.report_summary(scored).first()
    assert (s.total_cmls, s.recommended_eliminations, s.recommended_keep, s.elimination_rate) == (3, 1, 2, 33.3)
    f = P.report_summary(scored, "final_decision").first()
    assert f.recommended_eliminations == 1  # A: model and expert agree; B and C stay KEEP
    with pytest.raises(ValueError):
        P.report_summary(points.drop("elimination_probability"))
    counts = {(r.section, r.key): r.value for r in P.report_counts(scored).collect()}
    assert counts[("summary", "total_cmls")] == 3 and counts[("sizes", "marginal_cases")] == 1


def test_exact_medians(spark):
    import datetime as _d

    from pitwall.operators import features as FT

    df = _probs(spark, [0.1, 0.2, 0.3, 0.9, 0.95])
    assert D.probability_stats(df).first().median_probability == 0.3
    pts = spark.createDataFrame([("a", _d.date(2001, 12, 31)), ("b", _d.date(2001, 12, 21)), ("c", None)],
                                "id_number string, last_inspection_date date")
    out = {r.id_number: r.days_since_inspection
           for r in FT.days_since_inspection(pts, dt.date(2002, 1, 1), fill="median").collect()}
    assert out["c"] == 6.0


def test_empty_and_nan_probabilities(spark):
    none = spark.createDataFrame([], "id_number string, elimination_probability double, commodity string, feature_type string, "
                                     "average_corrosion_rate double, thickness_mm double")
    scored = D.decide_enhanced(none)
    assert D.score_summary(scored).first().elimination_rate is None
    s = P.report_summary(scored).first()
    assert s.total_cmls == 0 and s.elimination_rate == 0.0 and s.error == "No data to report"
    assert D.probability_stats(none).first().median_probability is None
    nan = D.decide_enhanced(_probs(spark, [float("nan")])).first()
    assert nan.predicted_elimination is None and nan.confidence_level is None and nan.recommendation is None


def test_elimination_report_on_final_decisions(spark):
    rows = [("A", 0.9, "Gas"), ("B", 0.9, "Gas"), ("C", 0.1, "Steam")]
    points = spark.createDataFrame([(i, p, c, "Pipe", 0.1, 9.0) for i, p, c in rows],
                                   "id_number string, elimination_probability double, commodity string, feature_type string, "
                                   "average_corrosion_rate double, thickness_mm double")
    log = O.new_override(spark, "B", "KEEP", "a sufficiently long reason", "x").unionByName(
        O.new_override(spark, "C", "ELIMINATE", "a sufficiently long reason", "x"))
    scored = P.scored_frame(points, O.current_overrides(log))
    rep = P.elimination_report(scored, "final_decision")
    assert rep["summary"].first().recommended_eliminations == 2
    assert {r.commodity: r.n_eliminations for r in rep["elimination_by_commodity"].collect()} == {"Gas": 1, "Steam": 1}
    assert [r.id_number for r in rep["top_elimination_candidates"].collect()] == ["A", "C"]
    counts = {(r.section, r.key): r.value for r in P.report_counts(scored, "final_decision").collect()}
    assert counts["elimination_by_commodity", "Steam"] == 1 and counts["summary", "recommended_keep"] == 1
