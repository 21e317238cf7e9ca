import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitwall.operators import forecast as FC

AS_OF = dt.date(2002, 1, 1)

# (t, rate, life, A months, A days, A thickness, A risk, B months, B days, B thickness, B risk)
EDGE = [
    (10, 0.1, 50.0, 72, 2190, 9.4, "LOW", 72, 2191, 9.4, "LOW"),
    (10, 0.0, 50.0, 72, 2190, 10.0, "LOW", 72, 2191, 10.0, "LOW"),
    (3, 0.1, 0.0, 6, 182, 2.95, "CRITICAL", 12, 365, 2.9, "CRITICAL"),
    (2.5, 0.6, 0.0, 6, 182, 2.2, "CRITICAL", 12, 365, 1.9, "CRITICAL"),
    (4.9, 0.04, 47.5, 72, 2190, 4.66, "LOW", 72, 2191, 4.66, "CRITICAL"),
    (5, 0.5, 4.0, 32, 973, 3.67, "HIGH", 22, 669, 4.08, "HIGH"),
    (5, 0.9, 2.2, 17, 540, 3.67, "HIGH", 12, 365, 4.1, "HIGH"),
    (6, 1.0, 3.0, 24, 730, 4.0, "HIGH", 16, 487, 4.67, "HIGH"),
    (6, 1.01, 3.0, 23, 722, 4.0, "HIGH", 16, 487, 4.65, "HIGH"),
    (5.5, 0.25, 10.0, 72, 2190, 4.0, "LOW", 56, 1704, 4.33, "MEDIUM"),
    (6, 0.26, 11.5, 72, 2190, 4.44, "LOW", 64, 1948, 4.61, "HIGH"),
    (7, 0.5, 8.0, 64, 1946, 4.33, "MEDIUM", 44, 1339, 5.17, "HIGH"),
    (8, 0.2, 25.0, 72, 2190, 6.8, "LOW", 72, 2191, 6.8, "MEDIUM"),
    (8, 0.21, 23.8, 72, 2190, 6.74, "LOW", 72, 2191, 6.74, "MEDIUM"),
    (3.3, 0.045, 6.7, 53, 1622, 3.1, "MEDIUM", 68, 2069, 3.04, "CRITICAL"),
    (9.5, 0.12, 50.0, 72, 2190, 8.78, "LOW", 72, 2191, 8.78, "LOW"),
    (12, 0.16, 50.0, 72, 2190, 11.04, "LOW", 72, 2191, 11.04, "MEDIUM"),
    (8.5, 0.18, 30.6, 72, 2190, 7.42, "LOW", 72, 2191, 7.42, "MEDIUM"),
]


@pytest.fixture(scope="module")
def edge_df(spark):
    rows = [(f"E{i:02d}", float(r[0]), float(r[1]), AS_OF) for i, r in enumerate(EDGE)]
    return spark.createDataFrame(rows, "id_number string, thickness_mm double, average_corrosion_rate double, "
                                       "last_inspection_date date")


def test_profile_b_edge_fixture(edge_df):
    got = {r.id_number: r for r in FC.forecast_b(edge_df, as_of=AS_OF).collect()}
    for i, e in enumerate(EDGE):
        r = got[f"E{i:02d}"]
        assert r.remaining_life_years == e[2], (i, r)
        assert r.recommended_inspection_frequency_months == e[7], (i, r)
        assert (r.next_inspection_date - AS_OF).days == e[8], (i, r)
        assert r.estimated_thickness_at_next_inspection == pytest.approx(e[9]), (i, r)
        assert r.risk_level == e[10], (i, r)


def test_profile_a_edge_fixture(edge_df):
    got = {r.id_number: r for r in FC.forecast_a(edge_df, as_of=AS_OF).collect()}
    for i, e in enumerate(EDGE):
        r = got[f"E{i:02d}"]
        assert r.remaining_life_years == e[2], (i, r)
        assert r.recommended_inspection_frequency_months == e[3], (i, r)
        assert (r.next_inspection_date - AS_OF).days == e[4], (i, r)
        assert r.estimated_thickness_at_next_inspection == pytest.approx(e[5]), (i, r)
        assert r.risk_level == e[6], (i, r)


def test_nulls_and_rejects(spark):
    rows = [("N1", None, 0.1), ("N2", 8.0, None), ("Z", 0.0, 0.1), ("NEG", 8.0, -0.1), ("OK", 8.0, 0.1)]
    df = spark.createDataFrame(rows, "id_number string, thickness_mm double, average_corrosion_rate double")
    b = {r.id_number: r for r in FC.forecast_b(df, as_of=AS_OF).collect()}
    for k in ("N1", "N2"):
        assert b[k].remaining_life_years is None and b[k].risk_level is None
        assert b[k].recommended_inspection_frequency_months is None and b[k].next_inspection_date is None
    a_ids = {r.id_number for r in FC.forecast_a(df, as_of=AS_OF).collect()}
    assert a_ids == {"OK"}
    rej = {r.id_number: r.reject_reason for r in FC.forecast_a_rejects(df).collect()}
    assert set(rej) == {"N1", "N2", "Z", "NEG"}
    assert rej["Z"] == "thickness must be positive"
    assert rej["NEG"] == "corrosion rate must be non-negative"


def test_reference_unit_cases(spark):
    df = spark.createDataFrame([("a", 10.0, 0.10), ("b", 10.0, 0.0), ("c", 4.0, 0.30)],
                               "id_number string, thickness_mm double, average_corrosion_rate double")
    r = {x.id_number: x for x in FC.forecast_b(df, as_of=AS_OF).collect()}
    assert r["a"].remaining_life_years == 50.0  # 70 years capped
    assert r["b"].remaining_life_years == 50.0  # zero corrosion
    assert r["c"].risk_level == "CRITICAL"
    a = {x.id_number: x for x in FC.forecast_a(df, as_of=AS_OF).collect()}
    assert a["c"].risk_level in ("HIGH", "CRITICAL") and a["c"].remaining_life_years < 10


def test_duplicate_ids_keep_row_count(spark):
    df = spark.createDataFrame([("d", 10.0, 0.12), ("d", 8.5, 0.18), ("e", 9.0, 0.1)],
                               "id_number string, thickness_mm double, average_corrosion_rate double")
    assert FC.forecast_b(df, as_of=AS_OF).count() == 3


def test_input_columns_kept_and_suffixed(spark):
    df = spark.createDataFrame([("x", 10.0, 0.1, 12.3)],
                               "id_number string, thickness_mm double, average_corrosion_rate double, "
                               "remaining_life_years double")
    r = FC.forecast_b(df, as_of=AS_OF).first()
    assert r.remaining_life_years == 12.3 and r.remaining_life_years_forecast == 50.0
    s = FC.forecast_summary(FC.forecast_b(df, as_of=AS_OF), as_of=AS_OF, source="input").first()
    assert s.avg_remaining_life_years == 12.3
    s = FC.forecast_summary(FC.forecast_b(df, as_of=AS_OF), as_of=AS_OF).first()
    assert s.avg_remaining_life_years == 50.0


def test_summary_and_top_priority(spark, edge_df):
    fc = FC.forecast_b(edge_df, as_of=AS_OF)
    s = FC.forecast_summary(fc, as_of=AS_OF).first()
    assert s.total_cmls == len(EDGE)
    assert s.n_critical + s.n_high + s.n_medium + s.n_low == len(EDGE)
    top = FC.top_priority_inspections(fc, 3).collect()
    assert [t.remaining_life_years for t in top] == [0.0, 0.0, 2.2]
    assert [t.id_number for t in top][:2] == ["E02", "E03"]  # tie broken by id
    due = FC.inspections_due(fc, as_of=AS_OF).count()
    assert due == sum(1 for e in EDGE if e[8] <= 365)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 50), st.floats(0, 5)), min_size=1, max_size=20))
def test_property_b_ranges(spark, rows):
    df = spark.createDataFrame([(f"p{i}", t, r) for i, (t, r) in enumerate(rows)],
                               "id_number string, thickness_mm double, average_corrosion_rate double")
    for r in FC.forecast_b(df, as_of=AS_OF).collect():
        assert 12 <= r.recommended_inspection_frequency_months <= 72
        assert 0.0 <= r.remaining_life_years <= 50.0
        assert r.estimated_thickness_at_next_inspection >= 0.0
        assert r.risk_level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def test_as_of_is_explicit(spark):
    df = spark.createDataFrame([("x", 10.0, 0.1)], "id_number string, thickness_mm double, "
                                                    "average_corrosion_rate double")
    d = dt.date(2020, 1, 1)
    r = FC.forecast_b(df, as_of=d).first()
    assert r.next_inspection_date == d + dt.timedelta(days=2191)


def test_ensure_ids(spark):
    df = spark.createDataFrame([(10.0, 0.1), (8.0, 0.2), (5.0, 0.9)],
                               "thickness_mm double, average_corrosion_rate double").repartition(2)
    out = FC.forecast_b(FC.ensure_ids(df), as_of=AS_OF)
    ids = [r.id_number for r in out.collect()]
    assert len(set(ids)) == 3 and all(i.startswith("CML-") for i in ids)
    assert FC.top_priority_inspections(out, 1).count() == 1
    with_ids = spark.createDataFrame([("x", 1.0, 0.1)], "id_number string, thickness_mm double, "
                                                        "average_corrosion_rate double")
    assert FC.ensure_ids(with_ids).columns == with_ids.columns


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 50), st.floats(0, 5)), min_size=1, max_size=20))
def test_property_a_ranges(spark, rows):
    df = spark.createDataFrame([(f"p{i}", t, r) for i, (t, r) in enumerate(rows)],
                               "id_number string, thickness_mm double, average_corrosion_rate double")
    got = FC.forecast_a(df, as_of=AS_OF).collect()
    assert len(got) == len(rows)  # every row is accepted (t > 0, rate >= 0)
    thickness = {f"p{i}": t for i, (t, _r) in enumerate(rows)}
    for r in got:
        m = r.recommended_inspection_frequency_months
        assert m == 6 or 12 <= m <= 72
        assert (m == 6) == (thickness[r.id_number] <= 3.0)  # life is 0 exactly when t <= minimum
        assert (r.next_inspection_date - AS_OF).days in range(182, 2191)
        # risk uses the unrounded life: a rounded 10.0 may still be MEDIUM (9.97)
        if r.remaining_life_years >= 10.1:
            assert r.risk_level == "LOW"
        if thickness[r.id_number] <= 3.0:
            assert r.risk_level == "CRITICAL"


def test_own_columns_and_malformed_dates(spark):
    df = spark.createDataFrame([("x", 10.0, 0.1, 1.5, "2028-00-08"), ("y", 4.0, 0.5, 30.0, "2002-05-01")],
                               "id_number string, thickness_mm double, average_corrosion_rate double, "
                               "remaining_life_years double, next_inspection_date string")
    fc = FC.forecast_b(df, as_of=AS_OF)
    assert FC.forecast_summary(fc, as_of=AS_OF).first().inspections_needed_next_12_months == 1
    assert FC.forecast_summary(fc, as_of=AS_OF, source="input").first().inspections_needed_next_12_months == 1
    assert [r.id_number for r in FC.top_priority_inspections(fc, 1).collect()] == ["y"]
    assert [r.id_number for r in FC.top_priority_inspections(fc, 1, source="input").collect()] == ["x"]
    assert [r.id_number for r in FC.inspections_due(fc, as_of=AS_OF, source="input").collect()] == ["y"]
    with pytest.raises(ValueError):
        FC.output_column(fc, "remaining_life_years", "both")


def test_nan_gives_no_forecast(spark):
    nan = float("nan")
    df = spark.createDataFrame([("t", nan, 0.1), ("r", 9.0, nan)], "id_number string, thickness_mm double, average_corrosion_rate double")
    for r in FC.forecast_b(df, as_of=AS_OF).collect():
        assert r.remaining_life_years is None and r.risk_level is None and r.recommended_inspection_frequency_months is None
    assert FC.forecast_a(df, as_of=AS_OF).count() == 0
    assert {r.reject_reason for r in FC.forecast_a_rejects(df).collect()} == {"thickness missing", "corrosion rate missing"}


def test_many_profiles_in_one_pass_equal_each_by_itself(spark):
    import datetime as dt

    from pitwall.operators import forecast as FC
    from pitwall.schema import ForecastB

    day = dt.date(2002, 1, 1)
    rows = [(f"p{i}", t, r, None if i % 3 else dt.date(2001, 5, 1 + i), "old", 7) for i, (t, r) in enumerate(
        [(8.0, 0.1), (2.5, 0.2), (5.0, 0.0), (None, 0.1), (9.0, None), (float("nan"), 0.3), (6.3, 0.26), (12.0, 0.04)])]
    df = spark.createDataFrame(rows, "id_number string, thickness_mm double, average_corrosion_rate double, last_inspection_date date, profile string, _profile int")
    named = [("default", ForecastB()), ("strict", ForecastB(minimum_thickness=4, safety_factor=3.0, min_interval_months=3, fast_factor=0.5)),
             ("lax", ForecastB(life_cap=80.0, critical_life=0.5, high_rate=0.5, month_days_num=30, month_days_den=1))]
    out = FC.forecast_profiles(df, FC.profile_table(spark, named), as_of=day)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and set(out.columns) >= {"profile", "_profile"}
    for name, p in named:
        alone = FC.forecast_b(df.drop("profile"), as_of=day, profile=p)
        got = out.where(out.profile == name).drop("profile").select(*alone.columns)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, alone.collect()), key=repr)
    none = FC.profile_table(spark, named).limit(0)
    assert FC.forecast_profiles(df, none, as_of=day).collect() == [] and FC.forecast_profiles(df.limit(0), FC.profile_table(spark, named), as_of=day).collect() == []
