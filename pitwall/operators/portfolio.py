"""Portfolio analytics (A1-A17) and bands (R1-R6): the tables behind the charts.

Life here follows the analytics rule: the input ``remaining_life_years`` when
the table has one, else (t - 3) / max(rate, 0.01); each operator applies its
own clip, as the original did.  Zero-filled outputs left-join a fixed-size bin
dimension (at most a few dozen rows, built from the bin definitions) to the
aggregated counts, so no data-sized side is ever broadcast or crossed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.core import (
    band,
    clip,
    count_if,
    dbl,
    exact_quantiles,
    literal_rows,
    normalise,
    r6,
    step_index,
    zero_filled_counts,
)
from ..schema import (
    CORROSION_BINS,
    CRITICAL_PCT_ALERT,
    CRITICAL_PCT_GAUGE_STEPS,
    INSPECTION_TIME_BINS,
    LIFE_GAUGE_STEPS,
    RATE_GAUGE_STEPS,
    RISK_BAND_4,
    RISK_BAND_5,
    THICKNESS_BINS,
    Analytics,
)

T_COL, R_COL, L_COL = "thickness_mm", "average_corrosion_rate", "remaining_life_years"


def analytics_life(df: DataFrame, lo: float | None = 0.0, hi: float | None = 50.0,
                   p: Analytics = Analytics()):
    """Life column per the analytics rule, clipped to [lo, hi] (None = open)."""
    if L_COL in df.columns:
        return clip(F.col(L_COL), lo=lo, hi=hi)
    return R.life_analytics(F.col(T_COL), F.col(R_COL), p, lo=lo, hi=hi)


def staged(df: DataFrame, p: Analytics = Analytics(), lo: float | None = 0.0, hi: float | None = 50.0) -> DataFrame:
    """Add ``_life`` (clipped to [lo, hi]), ``_months`` and ``_band4`` as columns.

    Staging them as columns (instead of nesting helper expressions) lets
    Catalyst compute each once per row: the optimizer does not inline a
    non-trivial expression that is referenced several times.
    """
    df = normalise(df)
    out = df.withColumn("_life", analytics_life(df, lo, hi, p))
    return out.withColumns({
        "_months": R.analytics_interval_months(F.col("_life"), p),
        "_band4": band(F.col("_life"), RISK_BAND_4),
    })


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def bin_dim(spark: SparkSession, bins, name: str) -> DataFrame:
    """Fixed-size dimension (order, label) of a bin definition."""
    rows = [(i, label) for i, (_lo, _hi, label) in enumerate(bins, start=1)]
    return literal_rows(spark, rows, f"{name}_order int, {name} string")


# ------------------------------------------------------------------- bands


def risk_bands(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """R1-R5 per point: 4- and 5-level risk bands, rate / thickness bins, time bucket."""
    st = staged(df, p, 0.0, p.life_cap)
    return st.select(
        "id_number",
        F.col("_life").alias("remaining_life_years"),
        F.col("_band4").alias("risk_band_4"),
        band(F.col("_life"), RISK_BAND_5).alias("risk_band_5"),
        band(F.col(R_COL), CORROSION_BINS).alias("corrosion_bin"),
        band(F.col(T_COL), THICKNESS_BINS).alias("thickness_bin"),
        F.col("_months").alias("inspection_months"),
        band(F.col("_months"), INSPECTION_TIME_BINS).alias("inspection_time_bucket"),
    )


# ------------------------------------------------------------------ A1-A17


def risk_matrix_dim(spark: SparkSession) -> DataFrame:
    """The 25 cells of A1."""
    cells = [
        (ti, tl, ci, cl)
        for ti, (_a, _b, tl) in enumerate(THICKNESS_BINS, start=1)
        for ci, (_c, _d, cl) in enumerate(CORROSION_BINS, start=1)
    ]
    return literal_rows(spark, cells, "thickness_order int, thickness_bin string, corrosion_order int, "
                                      "corrosion_bin string")


def risk_matrix(df: DataFrame) -> DataFrame:
    """A1: counts on thickness bin x corrosion bin, all 25 cells zero-filled."""
    dim = risk_matrix_dim(_spark(df))
    keyed = df.select(band(F.col(T_COL), THICKNESS_BINS).alias("thickness_bin"),
                      band(F.col(R_COL), CORROSION_BINS).alias("corrosion_bin"))
    return zero_filled_counts(keyed, dim, ["thickness_bin", "corrosion_bin"],
                              ["thickness_order", "corrosion_order"]).select(
        "thickness_order", "thickness_bin", "corrosion_order", "corrosion_bin", "n_points")


def risk_matrix_wide(df: DataFrame) -> DataFrame:
    """A1 in chart form: one row per thickness bin, one column per rate bin."""
    labels = [lbl for _a, _b, lbl in CORROSION_BINS]
    return (
        risk_matrix(df)
        .groupBy("thickness_order", "thickness_bin")
        .pivot("corrosion_bin", labels)
        .agg(F.sum("n_points"))
    )


def histogram_dim(spark: SparkSession, p: Analytics) -> DataFrame:
    """The bins of A2, the underflow bin first."""
    n, width = p.histogram_bins, p.life_cap / p.histogram_bins
    rows = [(-1, None, 0.0)] + [(i, i * width, (i + 1) * width) for i in range(n)]
    return literal_rows(spark, rows, "bin_index int, bin_lo double, bin_hi double")


def life_histogram(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A2: fixed [0, 50] histogram of life (upper clip only), 20 bins, plus
    an underflow row (index -1) for negative lives; mean life on every row."""
    n = p.histogram_bins
    width = p.life_cap / n
    vals = normalise(df).select(analytics_life(df, None, p.life_cap, p).alias("x"))
    dim = histogram_dim(_spark(df), p)
    # NULL lives fall in no bin (dropped); every other life lands in exactly
    # one bin, so the mean is total / count over the bins -- computed on the
    # 21 grouped rows, in the same pass as the counts.
    keyed = vals.select(bin_index(F.col("x"), width, n).alias("bin_index"), "x")
    bins = zero_filled_counts(keyed, dim, ["bin_index"], ["bin_lo", "bin_hi"], sums=("x",))
    everything = Window.partitionBy()  # over the 21 bin rows only
    mean = F.sum("sum_x").over(everything) / F.sum("n_points").over(everything)
    return bins.select("bin_index", "bin_lo", "bin_hi", "n_points", r6(mean).alias("mean_life"))


def bin_index(x, width: float, n: int):
    """Bin of x in [0, n*width]: the top edge joins the last bin; x < 0 -> -1."""
    return (F.when(x.isNull(), F.lit(None).cast("int")).when(x < 0, F.lit(-1))
            .otherwise(F.least(F.floor(x / dbl(width)), F.lit(n - 1)).cast("int")))


def corrosion_by_commodity(df: DataFrame) -> DataFrame:
    """A3: per commodity quartiles (exact, linear interpolation), min / max,
    Tukey fences, and the rank by median (descending, ties by name)."""
    df = normalise(df)
    r = F.col(R_COL)
    used = df.where(F.col("commodity").isNotNull() & r.isNotNull())
    agg = used.groupBy("commodity").agg(F.count(r).alias("n_points"), F.min(r).alias("min_rate"),
                                        F.max(r).alias("max_rate"), F.avg(r).alias("_mean"))
    q = exact_quantiles(used, {"_q": r}, {"_q": [0.25, 0.5, 0.75]}, by="commodity")
    agg = agg.join(q, "commodity").select(
        "commodity", "n_points", "min_rate", "max_rate", F.col("_q")[0].alias("q1"),
        F.col("_q")[1].alias("median_rate"), F.col("_q")[2].alias("q3"), "_mean")
    # Window over the aggregated result (one row per commodity), not the data.
    w = Window.orderBy(F.col("median_rate").desc(), F.col("commodity").asc())
    iqr = F.col("q3") - F.col("q1")
    return agg.select(
        "commodity", "n_points", "min_rate", "max_rate",
        r6(F.col("q1")).alias("q1"), r6(F.col("median_rate")).alias("median_rate"), r6(F.col("q3")).alias("q3"),
        r6(F.col("_mean")).alias("mean_rate"),
        r6(F.col("q1") - dbl(1.5) * iqr).alias("lower_fence"),
        r6(F.col("q3") + dbl(1.5) * iqr).alias("upper_fence"),
        F.row_number().over(w).alias("median_rank"),
    )


def inspection_priority_points(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A4: per point rate, thickness, life (clip 0..50), 4-level band, flag t < 3."""
    st = staged(df, p, 0.0, p.life_cap)
    return st.select(
        "id_number", "commodity", "feature_type",
        F.col(R_COL).alias("average_corrosion_rate"), F.col(T_COL).alias("thickness_mm"),
        F.col("_life").alias("remaining_life_years"),
        F.col("_band4").alias("risk_category"),
        (F.col(T_COL) < dbl(p.below_min_thickness)).alias("below_min_thickness"),
    )


def feature_commodity_hierarchy(df: DataFrame) -> DataFrame:
    """A5: counts feature type -> commodity with parent totals (rollup, no grand total)."""
    return (
        df.rollup("feature_type", "commodity")
        .agg(F.count(F.lit(1)).alias("n_points"), F.grouping_id().alias("level"))
        .where(F.col("level") < 3)
        .select("feature_type", "commodity", F.col("level").cast("int").alias("level"), "n_points")
    )


def portfolio_health(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Avg life (clip 0..50), % of points with life < 2, avg rate, gauge bands."""
    life = F.col("_life")
    one = staged(df, p, 0.0, p.life_cap).agg(
        F.avg(life).alias("avg_life"),
        F.try_divide(count_if(life < dbl(p.critical_life)) * dbl(100.0), F.count(F.lit(1))).alias("critical_pct"),
        F.avg(R_COL).alias("avg_rate"),
    )
    return one.select(
        r6(F.col("avg_life")).alias("avg_remaining_life_years"),
        r6(F.col("critical_pct")).alias("critical_pct"),
        r6(F.col("avg_rate")).alias("avg_corrosion_rate"),
        step_index(F.col("avg_life"), LIFE_GAUGE_STEPS).alias("life_band"),
        step_index(F.col("critical_pct"), CRITICAL_PCT_GAUGE_STEPS).alias("critical_band"),
        step_index(F.col("avg_rate"), RATE_GAUGE_STEPS).alias("rate_band"),
        (F.col("critical_pct") > dbl(CRITICAL_PCT_ALERT)).alias("critical_alert"),
    )


LIFE_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]


def _quantile_row(st: DataFrame, columns: dict, probs: dict):
    """The exact quantiles of the whole table as one struct (a scalar subquery on one row)."""
    return exact_quantiles(st, columns, probs).select(F.struct(*columns)).scalar()


def _life_stats_cols(life, q):
    """``q``: the array of LIFE_PROBS quantiles."""
    return [
        r6(F.avg(life)).alias("life_mean"), r6(q[2]).alias("life_median"),
        r6(F.stddev_samp(life)).alias("life_std"), r6(F.min(life)).alias("life_min"),
        r6(F.max(life)).alias("life_max"),
        r6(q[0]).alias("life_p10"), r6(q[1]).alias("life_p25"), r6(q[3]).alias("life_p75"),
        r6(q[4]).alias("life_p90"),
    ]


def life_statistics(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Mean, median, std, min, max, p10/25/75/90 of life clipped to [0, 50]."""
    st, life = staged(df, p, 0.0, p.life_cap), F.col("_life")
    q = _quantile_row(st, {"life": life}, {"life": LIFE_PROBS})
    return st.agg(*_life_stats_cols(life, q["life"]))


def _corrosion_cols(p: Analytics, median):
    r = F.col(R_COL)
    return [
        r6(F.avg(r)).alias("rate_mean"), r6(median).alias("rate_median"),
        r6(F.stddev_samp(r)).alias("rate_std"), F.max(r).alias("rate_max"),
        count_if(r > dbl(p.high_corrosion)).alias("high_corrosion_count"),
    ]


def corrosion_statistics(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Mean, median, std, max of rate and the count above 0.15."""
    df = normalise(df)
    q = _quantile_row(df, {"rate": F.col(R_COL)}, {"rate": [0.5]})
    return df.agg(*_corrosion_cols(p, q["rate"][0]))


def _thickness_cols(p: Analytics):
    t = F.col(T_COL)
    return [
        r6(F.avg(t)).alias("thickness_mean"), F.min(t).alias("thickness_min"),
        count_if(t < dbl(p.below_min_thickness)).alias("below_min_count"),
        count_if(t < dbl(p.thin_wall)).alias("thin_wall_count"),
    ]


def thickness_statistics(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Mean and min thickness, counts below 3.0 and below 5.0."""
    return normalise(df).agg(*_thickness_cols(p))


def _risk_dist_cols(b):
    return [count_if(b == lbl).alias(lbl.lower()) for _lo, _hi, lbl in RISK_BAND_4]


def risk_distribution(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A10: 4-band counts with fixed keys (life 0 falls out of every band)."""
    return staged(df, p, 0.0, p.life_cap).agg(*_risk_dist_cols(F.col("_band4")))


def _scheduling_cols(life, months):
    return [
        count_if(life < dbl(1.0)).alias("immediate_attention"),
        count_if(life < dbl(2.0)).alias("next_6_months"),
        count_if(life < dbl(3.0)).alias("next_12_months"),
        r6(F.avg(months)).alias("avg_interval_months"),
    ]


def inspection_scheduling(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Cumulative counts life < 1 / 2 / 3 and the mean interval in months."""
    return staged(df, p, 0.0, p.life_cap).agg(*_scheduling_cols(F.col("_life"), F.col("_months")))


def commodity_risk(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Per commodity count, mean rate, count of raw life (no clip) < 2."""
    raw_life = F.col("_raw_life")
    return (
        normalise(df).withColumn("_raw_life", R.life_analytics(F.col(T_COL), F.col(R_COL), p, lo=None, hi=None))
        .where(F.col("commodity").isNotNull())
        .groupBy("commodity")
        .agg(F.count(F.lit(1)).alias("n_points"), r6(F.avg(R_COL)).alias("avg_corrosion"),
             count_if(raw_life < dbl(p.critical_life)).alias("critical_count"))
    )


def inspection_timeline(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Interval-month buckets in bin order, zero-filled."""
    spark = _spark(df)
    keyed = staged(df, p, 0.0, p.life_cap).select(band(F.col("_months"), INSPECTION_TIME_BINS).alias("bucket"))
    dim = bin_dim(spark, INSPECTION_TIME_BINS, "bucket")
    return zero_filled_counts(keyed, dim, ["bucket"], ["bucket_order"]).select("bucket_order", "bucket", "n_points")


def report_metrics(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """Dashboard tiles: rows, mean life (clip 0..50), rate > 0.2, t < 5."""
    return staged(df, p, 0.0, p.life_cap).agg(
        F.count(F.lit(1)).alias("total_assets"),
        r6(F.avg("_life")).alias("avg_remaining_life_years"),
        count_if(F.col(R_COL) > dbl(p.dashboard_high_corrosion)).alias("high_corrosion_cmls"),
        count_if(F.col(T_COL) < dbl(p.thin_wall)).alias("thin_wall_cmls"),
    )


def dashboard_decision_counts(scored: DataFrame, flag_col: str = "predicted_elimination_flag") -> DataFrame:
    """Candidates for elimination and points kept for monitoring."""
    return scored.agg(
        count_if(F.col(flag_col) == 1).alias("elimination_candidates"),
        count_if(F.col(flag_col) == 0).alias("monitoring_points"),
    )


def advanced_statistics(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A7-A11 plus the total in one row of nested structs, with A12 as an
    array of per-commodity structs (one entry per commodity).

    Besides the quantiles' pass, one pass with the grouping sets () and
    (commodity); the row is put together from those few rows.
    """
    life = F.col("_life")
    st = staged(df, p, 0.0, p.life_cap).withColumn(
        "_raw_life", R.life_analytics(F.col(T_COL), F.col(R_COL), p, lo=None, hi=None))
    q = _quantile_row(st, {"life": life, "rate": F.col(R_COL)}, {"life": LIFE_PROBS, "rate": [0.5]})
    sections = {
        "remaining_life": _life_stats_cols(life, q["life"]),
        "corrosion_rate": _corrosion_cols(p, q["rate"][0]),
        "thickness": _thickness_cols(p),
        "risk_distribution": _risk_dist_cols(F.col("_band4")),
        "inspection_scheduling": _scheduling_cols(life, F.col("_months")),
    }
    g = st.groupingSets([[], ["commodity"]], "commodity").agg(
        F.grouping("commodity").alias("_all"),
        F.count(F.lit(1)).alias("total_cmls"),
        *[F.struct(*cols).alias(name) for name, cols in sections.items()],
        r6(F.avg(R_COL)).alias("_avg"),
        count_if(F.col("_raw_life") < dbl(p.critical_life)).alias("_critical"),
    )
    every = lambda name: F.max(F.when(F.col("_all") == 1, F.col(name))).alias(name)
    per = F.struct("commodity", F.col("total_cmls").alias("n_points"), F.col("_avg").alias("avg_corrosion"),
                   F.col("_critical").alias("critical_count"))
    return g.agg(
        F.coalesce(F.max(F.when(F.col("_all") == 1, F.col("total_cmls"))), F.lit(0)).alias("total_cmls"), *[every(name) for name in sections],
        F.sort_array(F.collect_list(F.when((F.col("_all") == 0) & F.col("commodity").isNotNull(), per))).alias("commodity_risk"),
    )


def advanced_statistics_flat(df: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A16 as flat columns (the same aggregation, without the per-commodity list)."""
    one = advanced_statistics(df, p).drop("commodity_risk")
    return one.select("total_cmls", "remaining_life.*", "corrosion_rate.*", "thickness.*", "risk_distribution.*",
                      "inspection_scheduling.*")


def corrosion_vs_thickness(df: DataFrame) -> DataFrame:
    """Scatter table; marker size is the risk score (fallback formula if absent)."""
    size = F.col("risk_score") if "risk_score" in df.columns else R.risk_score_fallback(F.col(T_COL), F.col(R_COL))
    return normalise(df).select("id_number", R_COL, T_COL, "commodity", size.alias("marker_size"))
