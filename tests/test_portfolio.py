import pytest
from pyspark.sql import functions as F

from pitwall.operators import portfolio as PF

# Invented rows.
FIVE = [
    ("PUMP-7", 0.11, 8.8, 33.0, "Steam", "Elbow", "Internal"),
    ("LINE-2a", 0.07, 11.4, 71.5, "Gas", "Pipe", "Both"),
    ("TANK-19", 0.31, 5.2, 6.5, "Condensate", "Tee", "External"),
    ("LINE-2b", 0.02, 9.6, 120.0, "Gas", "Weld", "Both"),
    ("PUMP-8", 0.16, 6.9, 18.0, "Steam", "Pipe", "Internal"),
]


@pytest.fixture(scope="module")
def five(spark):
    return spark.createDataFrame(FIVE, "id_number string, average_corrosion_rate double, thickness_mm double, "
                                       "remaining_life_years double, commodity string, feature_type string, "
                                       "cml_shape string")


def test_five_point_goldens(five):
    life = PF.life_statistics(five).first()
    assert life.life_mean == pytest.approx(31.5)
    assert life.life_median == 33
    assert life.life_std == pytest.approx(19.326148, abs=1e-6)
    assert life.life_p10 == pytest.approx(11.1)
    assert life.life_p25 == 18 and life.life_p75 == 50 and life.life_p90 == 50
    rate = PF.corrosion_statistics(five).first()
    assert rate.rate_mean == pytest.approx(0.134) and rate.rate_median == pytest.approx(0.11)
    assert rate.rate_std == pytest.approx(0.111041, abs=1e-6) and rate.high_corrosion_count == 2
    th = PF.thickness_statistics(five).first()
    assert th.thickness_mean == pytest.approx(8.38) and th.thickness_min == 5.2
    rd = PF.risk_distribution(five).first()
    assert (rd.critical, rd.high, rd.medium, rd.low) == (0, 0, 1, 4)


def test_risk_matrix_zero_filled(five, spark):
    m = PF.risk_matrix(five).collect()
    assert len(m) == 25
    assert sum(r.n_points for r in m) == 5
    wide = PF.risk_matrix_wide(five).collect()
    assert len(wide) == 5


def test_bins_right_closed(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("b", 0.05, 7.0), ("c", 0.10, 9.0), ("d", 0.15, 11.0),
                                ("e", 0.20, 11.01), ("f", None, None)],
                               "id_number string, average_corrosion_rate double, thickness_mm double")
    b = {r.id_number: r for r in PF.risk_bands(df).collect()}
    assert b["a"].corrosion_bin is None  # rate 0 falls out of (0, .05]
    assert b["b"].corrosion_bin == "<0.05" and b["c"].corrosion_bin == "0.05-0.10"
    assert b["d"].corrosion_bin == "0.10-0.15" and b["e"].corrosion_bin == "0.15-0.20"
    assert b["a"].thickness_bin == "<5mm" and b["b"].thickness_bin == "5-7mm" and b["e"].thickness_bin == ">11mm"
    assert b["f"].remaining_life_years is None and b["f"].risk_band_4 is None


def test_life_zero_out_of_bands_but_counted(spark):
    df = spark.createDataFrame([("z", 0.1, 2.0), ("w", 0.1, 10.0)],
                               "id_number string, average_corrosion_rate double, thickness_mm double")
    rd = PF.risk_distribution(df).first()
    assert rd.critical + rd.high + rd.medium + rd.low == 1  # life 0 falls out
    sch = PF.inspection_scheduling(df).first()
    assert sch.immediate_attention == 1
    h = PF.portfolio_health(df).first()
    assert h.critical_pct == 50.0


def test_timeline_and_histogram(five):
    tl = PF.inspection_timeline(five).collect()
    assert [r.bucket for r in sorted(tl, key=lambda r: r.bucket_order)] == [
        "0-6mo", "6-12mo", "1-2yr", "2-3yr", "3-6yr", ">6yr"]
    assert sum(r.n_points for r in tl) == 5
    h = PF.life_histogram(five).collect()
    assert len(h) == 21 and sum(r.n_points for r in h) == 5
    assert h[0].mean_life == pytest.approx(31.5)


def test_hierarchy_rollup(five):
    rows = PF.feature_commodity_hierarchy(five).collect()
    parents = {r.feature_type: r.n_points for r in rows if r.level == 1}
    assert parents == {"Pipe": 2, "Elbow": 1, "Tee": 1, "Weld": 1}
    assert sum(r.n_points for r in rows if r.level == 0) == 5


def test_advanced_statistics_one_row(five):
    r = PF.advanced_statistics(five).first()
    assert r.total_cmls == 5
    assert r.remaining_life.life_mean == pytest.approx(31.5)
    assert [c.commodity for c in r.commodity_risk] == ["Condensate", "Gas", "Steam"]


def test_empty_table(spark):
    none = spark.createDataFrame([], "id_number string, average_corrosion_rate double, thickness_mm double, commodity string")
    h = PF.portfolio_health(none).first()
    assert h.critical_pct is None and h.avg_remaining_life_years is None
    assert PF.life_statistics(none).first().life_median is None
    assert PF.advanced_statistics(none).first().total_cmls == 0


def test_nan_is_missing_not_safe(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0.1, nan, "Gas"), ("b", nan, 9.0, "Gas"), ("c", 0.1, 9.0, "Gas")],
                               "id_number string, average_corrosion_rate double, thickness_mm double, commodity string")
    b = {r.id_number: r for r in PF.risk_bands(df).collect()}
    for k in ("a", "b"):
        assert b[k].remaining_life_years is None and b[k].risk_band_4 is None and b[k].risk_band_5 is None
        assert b[k].inspection_months == 6.0
    assert b["a"].thickness_bin is None and b["b"].corrosion_bin is None
    rd = PF.risk_distribution(df).first()
    assert (rd.critical, rd.high, rd.medium, rd.low) == (0, 0, 0, 1)
    assert PF.life_statistics(df).first().life_max == 50.0 and PF.life_statistics(df).first().life_min == 50.0
    assert sum(r.n_points for r in PF.life_histogram(df).collect()) == 1
    assert PF.corrosion_statistics(df).first().rate_max == 0.1
    assert PF.thickness_statistics(df).first().thickness_mean == 9.0


def test_exact_quantiles_of_distinct_doubles(spark):
    import numpy as np

    from pitwall.functions.core import exact_quantiles

    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in ("x", "y", None) for v in rng.normal(size=701 if k == "x" else 500)]
    rows += [("x", None), ("y", float("nan")), ("z", None), ("w", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["v"] for r in exact_quantiles(df, {"v": F.col("v")}, {"v": probs}, by="k").collect()}
    assert set(got) == {"x", "y", None, "w"}
    for k in ("x", "y", None):
        own = [v for a, v in rows if a == k and v is not None and v == v]
        assert got[k] == pytest.approx(list(np.quantile(own, probs)))
    frame = exact_quantiles(df, {"v": F.col("v"), "w": F.col("v") * 2}, {"v": [0.5], "w": [0.25]})
    every = [v for _, v in rows if v is not None and v == v]
    one = frame.first()
    assert one["v"][0] == pytest.approx(np.median(every)) and one["w"][0] == pytest.approx(2 * np.quantile(every, 0.25))


def test_no_percentile_over_raw_rows(spark, five):
    for f in (PF.life_statistics, PF.corrosion_statistics, PF.corrosion_by_commodity, PF.advanced_statistics):
        plan = f(five)._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "median(" not in plan


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.floats(0, 0.5)), st.one_of(st.none(), st.floats(0, 15))),
                min_size=1, max_size=40))
def test_bins_plus_fallouts_equal_total(spark, rows):
    df = spark.createDataFrame([(f"p{i}", r, t) for i, (r, t) in enumerate(rows)],
                               "id_number string, average_corrosion_rate double, thickness_mm double")
    in_cells = sum(r.n_points for r in PF.risk_matrix(df).collect())
    fallouts = sum(1 for r, t in rows if r is None or t is None or r <= 0 or t <= 0)
    assert in_cells + fallouts == len(rows)
    rd = PF.risk_distribution(df).first()
    banded = rd.critical + rd.high + rd.medium + rd.low
    bands = {r.id_number: r.risk_band_4 for r in PF.risk_bands(df).collect()}
    assert banded == sum(1 for b in bands.values() if b is not None)
    tl = sum(r.n_points for r in PF.inspection_timeline(df).collect())
    assert tl == len(rows)  # a NULL or zero life counts as the 0.5-year interval
