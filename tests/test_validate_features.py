import datetime as dt

import pytest

from pitwall.operators import features as FT
from pitwall.operators import validate as V
from pitwall.schema import Validation

SCHEMA = ("id_number string, average_corrosion_rate double, thickness_mm double, commodity string, "
          "feature_type string, cml_shape string")


def test_valid_table(spark):
    df = spark.createDataFrame([("VALVE-3", 0.21, 7.7, "Fuel Gas", "Bend", "External"),
                                ("VALVE-4", 0.03, 12.5, "Steam", "Nozzle", "Both")], SCHEMA)
    rep = {(r.severity, r.check_name): r for r in V.validation_report(df).collect()}
    assert rep[("info", "valid")].n == 1 and rep[("info", "total_records")].n == 2
    assert rep[("info", "avg_corrosion_rate")].detail == "0.120000" and rep[("info", "commodity:Steam")].n == 1
    assert not [k for k in rep if k[0] == "error"]
    prof = V.dataset_profile(df).first()
    assert prof.total_records == 2 and prof.unique_cmls == 2


def test_missing_columns(spark):
    df = spark.createDataFrame([("VALVE-3", 0.21)], "id_number string, average_corrosion_rate double")
    assert V.missing_columns(df) == ["cml_shape", "commodity", "feature_type", "thickness_mm"]
    rep = {(r.severity, r.check_name): r for r in V.validation_report(df).collect()}
    assert rep[("info", "valid")].n == 0 and ("error", "missing_columns") in rep


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert not V.check_not_empty(df)
    rep = {(r.severity, r.check_name) for r in V.validation_report(df).collect()}
    assert ("error", "empty") in rep


def test_duplicates_nulls_ranges(spark):
    df = spark.createDataFrame([
        ("VALVE-3", 0.21, 7.7, "Fuel Gas", "Bend", "External"),
        ("VALVE-3", 0.03, 12.5, "Steam", "Nozzle", "Both"),
        ("VALVE-3", 5.2, 61.0, "Gas", "Tee", "Both"),
        ("VALVE-5", -0.4, 0.0, None, "Pipe", "Both"),
        ("VALVE-6", None, float("nan"), "Gas", "Pipe", "Both"),
    ], SCHEMA)
    d = V.duplicate_ids(df).first()
    assert d.n_duplicates == 2 and d.examples == "VALVE-3"
    nulls = {r.column_name: r.null_count for r in V.null_counts(df).collect()}
    assert nulls == {"average_corrosion_rate": 1, "thickness_mm": 1, "commodity": 1}
    c = V.corrosion_range_violations(df).first()
    assert c.n_violations == 2 and c.examples == "VALVE-3, VALVE-5"
    t = V.thickness_range_violations(df).first()
    assert t.n_violations == 2
    rows = {r.id_number: r for r in V.row_contract_split(df).collect() if r.id_number != "VALVE-3"}
    assert not rows["VALVE-5"].is_valid and "commodity empty" in rows["VALVE-5"].reasons
    assert "average_corrosion_rate missing" in rows["VALVE-6"].reasons


def test_override_contract(spark):
    df = spark.createDataFrame([
        ("a", "KEEP", "long enough reason", "x", None, None, 0.5),
        ("b", "MAYBE", "long enough reason", "x", None, None, None),
        ("c", "KEEP", "short", "x", None, None, 1.5),
    ], "id_number string, sme_decision string, reason string, sme_name string, override_date timestamp_ntz, "
       "original_prediction string, original_probability double")
    r = {x.id_number: x for x in V.override_contract_split(df).collect()}
    assert r["a"].is_valid
    assert r["b"].reasons == "sme_decision invalid"
    assert r["c"].reasons == "reason too short; original_probability out of range"
    r9 = {x.id_number: x for x in V.override_contract_split(df, Validation(min_reason_len=5)).collect()}
    assert r9["c"].reasons == "original_probability out of range"


def test_domain_check(spark):
    df = spark.createDataFrame([("a", 0.1, 9.0, "Gas", "Pipe", "Both"), ("b", 0.1, 9.0, "Gas", "Spool", "Round")],
                               SCHEMA)
    got = {(r.column_name, r.value): r.n_points for r in V.domain_check(df).collect()}
    assert got == {("feature_type", "Spool"): 1, ("cml_shape", "Round"): 1}


def test_features(spark):
    df = spark.createDataFrame([
        ("a", 0.2, 10.0, "2001-12-31", "Gas", "Pipe", "Both"),
        ("b", 0.0, 2.0, "2028-00-08", "Gas", "Pipe", "Both"),
        ("c", 0.1, 7.0, None, "Gas", "Pipe", "Both"),
    ], "id_number string, average_corrosion_rate double, thickness_mm double, last_inspection_date string, "
       "commodity string, feature_type string, cml_shape string")
    s = {r.id_number: r for r in FT.scoring_features(df, as_of=dt.date(2002, 1, 1)).collect()}
    assert s["a"].corrosion_thickness_ratio == pytest.approx(0.02)
    assert s["a"].remaining_life_years == pytest.approx(35.0)
    assert s["b"].remaining_life_years is None  # rate 0: no finite life
    assert s["a"].days_since_inspection == 1
    assert s["b"].days_since_inspection == 365  # malformed date -> default
    assert s["c"].days_since_inspection == 365
    assert s["a"].risk_score == pytest.approx(4.0)
    assert s["b"].risk_score == pytest.approx(40.0)
    m = {r.id_number: r for r in FT.scoring_features(df, as_of=dt.date(2002, 1, 1), fill="median").collect()}
    assert m["c"].days_since_inspection == 1.0
    t = {r.id_number: r for r in FT.training_features(df, dt.date(2002, 1, 1)).collect()}
    assert (t["a"].high_corrosion, t["a"].thin_wall, t["c"].thin_wall, t["c"].risk_interaction) == (1, 0, 1, 0)


def test_report_examples_and_missing(spark):
    rows = [("VALVE-3", 0.21, 7.7, "Gas", "Bend", "Both")] * 2 + [("VALVE-5", -0.4, 0.0, None, "Pipe", "Both")] * 4 + [
        ("VALVE-6", None, float("nan"), "Gas", "Pipe", "Both"), (None, 9.0, 9.0, "Gas", "Pipe", "Both")]
    rep = {r.check_name: r for r in V.validation_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rep["duplicate_ids"].n == 4 and rep["duplicate_ids"].detail == "VALVE-3, VALVE-5"
    assert rep["corrosion_range"].n == 5 and rep["corrosion_range"].detail == "VALVE-5, VALVE-5, VALVE-5"
    assert rep["nulls:thickness_mm"].n == 1 and rep["nulls:id_number"].n == 1
    assert rep["total_records"].n == 8 and rep["unique_cmls"].n == 3


def test_required_column_variants(spark):
    from pitwall.schema import REQUIRED_POINT_COLUMNS_WITH_DATES, REQUIRED_TRAINING_COLUMNS

    df = spark.createDataFrame([], SCHEMA)
    assert V.missing_columns(df, REQUIRED_TRAINING_COLUMNS) == ["elimination_flag"]
    assert V.missing_columns(df, REQUIRED_POINT_COLUMNS_WITH_DATES) == ["last_inspection_date", "next_inspection_date"]
