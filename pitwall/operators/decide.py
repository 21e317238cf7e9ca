"""Decisions from elimination probabilities.

Two response shapes existed: the basic one (flag, recommendation, two-level
confidence) and the enhanced one (flag, keep probability, numeric confidence,
three-level confidence).  Both are offered; summaries never run after the
100-row display limit (D6) -- they always see every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.core import count_if, dbl, exact_quantiles, missing, r6
from ..schema import Decisions

P = "elimination_probability"


def decide_basic(df: DataFrame, prob: str = P, d: Decisions = Decisions()) -> DataFrame:
    """D2 + D3: flag p > 0.5, ELIMINATE / KEEP, HIGH / MODERATE confidence."""
    p = F.col(prob)
    return df.withColumns({
        "predicted_elimination_flag": R.decision_flag(p, d),
        "recommendation": R.recommendation(R.decision_flag(p, d)),
        "confidence": R.confidence_two_level(p, d),
    })


def decide_enhanced(df: DataFrame, prob: str = P, d: Decisions = Decisions()) -> DataFrame:
    """D2 + D4: flag, keep probability, numeric and three-level confidence."""
    p = F.col(prob)
    return df.withColumns({
        "predicted_elimination": R.decision_flag(p, d),
        "keep_probability": dbl(1.0) - p,
        "recommendation": R.recommendation(R.decision_flag(p, d)),
        "confidence": R.confidence_score(p),
        "confidence_level": R.confidence_three_level(p, d),
    })


def score_summary(scored: DataFrame, flag: str = "predicted_elimination") -> DataFrame:
    """Total, eliminate, keep, elimination rate (fraction; NULL if empty), high-confidence eliminations."""
    f = F.col(flag)
    return scored.agg(
        F.count(F.lit(1)).alias("total_cmls"),
        count_if(f == 1).alias("recommended_eliminations"),
        count_if(f == 0).alias("recommended_keep"),
        r6(F.try_divide(count_if(f == 1), F.count(F.lit(1)))).alias("elimination_rate"),
        count_if((f == 1) & (F.col("confidence_level") == "HIGH")).alias("high_confidence_eliminations"),
    )


def limited_results(scored: DataFrame, n: int = 100, order_by: str = "id_number") -> DataFrame:
    """The first n rows by id, each carrying the total row count."""
    total = scored.agg(F.count(F.lit(1))).scalar()
    return scored.orderBy(order_by).limit(n).withColumn("total_results", total)


def decision_breakdown(scored: DataFrame) -> DataFrame:
    """Count and share (%) per recommendation and per confidence.

    One pass: grouping sets (recommendation), (confidence); the share is
    computed on the grouped rows (a handful), where each grouping set's
    counts sum to the total.
    """
    g = scored.groupingSets([["recommendation"], ["confidence"]], "recommendation", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    tidy = g.select(
        F.when(F.col("_gid") == 1, F.lit("recommendation")).otherwise(F.lit("confidence")).alias("dimension"),
        F.when(F.col("_gid") == 1, F.col("recommendation")).otherwise(F.col("confidence")).alias("value"),
        "n",
    )
    per_dim = Window.partitionBy("dimension")  # over the grouped rows only
    return tidy.withColumn("pct", r6(F.col("n") * dbl(100.0) / F.sum("n").over(per_dim)))


def probability_stats(scored: DataFrame, prob: str = P) -> DataFrame:
    """Mean, exact median, std of p; counts p > 0.8 and p < 0.2 (missing p left out)."""
    p = F.when(~missing(prob), F.col(prob))
    median = exact_quantiles(scored, {"m": p}, {"m": [0.5]}).select(F.col("m")[0]).scalar()
    return scored.agg(
        r6(F.avg(p)).alias("mean_probability"), r6(median).alias("median_probability"),
        r6(F.stddev_samp(p)).alias("std_probability"),
        count_if(p > dbl(0.8)).alias("n_above_0_8"), count_if(p < dbl(0.2)).alias("n_below_0_2"),
    )


def top_candidates(scored: DataFrame, n: int = 10, prob: str = P) -> DataFrame:
    """The n largest p (eliminate side) and the n smallest p (keep side)."""
    cols = ["id_number", prob, "confidence"] if "confidence" in scored.columns else ["id_number", prob]
    base = scored.where(F.col(prob).isNotNull())
    hi = base.orderBy(F.col(prob).desc(), F.col("id_number").asc()).limit(n).select(
        F.lit("eliminate").alias("side"), *cols)
    lo = base.orderBy(F.col(prob).asc(), F.col("id_number").asc()).limit(n).select(F.lit("keep").alias("side"),
                                                                                   *cols)
    return hi.unionByName(lo)


def cost_savings(scored: DataFrame, flag: str = "predicted_elimination_flag", d: Decisions = Decisions()) -> DataFrame:
    """Eliminated points x cost per inspection x inspections per year (1, 5, 10 years)."""
    n = count_if(F.col(flag) == 1)
    annual = n * F.lit(d.cost_per_inspection * d.inspections_per_year).cast("bigint")
    return scored.agg(
        n.alias("eliminated_cmls"),
        annual.alias("annual_savings"),
        (annual * F.lit(5)).alias("savings_5_years"),
        (annual * F.lit(10)).alias("savings_10_years"),
    )
