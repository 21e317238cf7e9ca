"""Elimination report.

The scored frame is built once (score -> decide -> apply overrides) and every
section is one aggregation or top-k over it.  :func:`elimination_report`
returns the sections as DataFrames; :func:`report_counts` folds the count
sections into one tidy frame (section, key, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, dbl, py_round
from ..schema import Decisions
from . import decide as D
from . import overrides as O


def scored_frame(points: DataFrame, override_state: DataFrame | None = None, prob: str = D.P) -> DataFrame:
    """P7 input: enhanced decisions, then expert overrides when a state is given."""
    scored = D.decide_enhanced(points, prob)
    if override_state is not None:
        scored = O.apply_overrides(scored, override_state)
    return scored


def _require(df: DataFrame, col: str) -> None:
    if col not in df.columns:
        raise ValueError(f'Column "{col}" not found in DataFrame')


def _decided(scored: DataFrame, decision_col: str):
    """(eliminated, kept) conditions of a 0/1 flag or an ELIMINATE / KEEP column."""
    _require(scored, decision_col)
    c = F.col(decision_col)
    return (c == "ELIMINATE", c == "KEEP") if dict(scored.dtypes)[decision_col] == "string" else (c == 1, c == 0)


def report_summary(scored: DataFrame, decision_col: str = "predicted_elimination") -> DataFrame:
    """Total, eliminations, keep, elimination rate in % (1 decimal).

    ``decision_col`` may be a 0/1 flag (default, as the original read the
    unchanged model flag) or ``final_decision`` (ELIMINATE / KEEP strings),
    so that expert overrides count.  For an empty table ``error`` says so.
    """
    is_elim, is_keep = _decided(scored, decision_col)
    agg = scored.agg(
        F.count(F.lit(1)).alias("total_cmls"),
        count_if(is_elim).alias("recommended_eliminations"),
        count_if(is_keep).alias("recommended_keep"),
    )
    pct = F.try_divide(F.col("recommended_eliminations") * dbl(100.0), F.col("total_cmls"))
    return agg.withColumn("_pct", pct).select(
        "total_cmls", "recommended_eliminations", "recommended_keep",
        F.coalesce(py_round("_pct", 1), dbl(0.0)).alias("elimination_rate"),
        F.when(F.col("total_cmls") == 0, F.lit("No data to report")).alias("error"))


def confidence_distribution(scored: DataFrame) -> DataFrame:
    """Rows per confidence level."""
    return scored.where(F.col("confidence_level").isNotNull()).groupBy("confidence_level").agg(
        F.count(F.lit(1)).alias("n_points"))


def eliminations_by(scored: DataFrame, column: str, decision_col: str = "predicted_elimination") -> DataFrame:
    """Eliminated rows per commodity or feature type."""
    return (
        scored.where(_decided(scored, decision_col)[0] & F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_eliminations"))
    )


def top_elimination_candidates(scored: DataFrame, n: int = 20, decision_col: str = "predicted_elimination",
                               prob: str = D.P) -> DataFrame:
    """P5: eliminated rows with the largest probability (ties by id)."""
    wanted = ["id_number", prob, "average_corrosion_rate", "thickness_mm"]
    cols = [c for c in wanted if c in scored.columns]
    return (
        scored.where(_decided(scored, decision_col)[0])
        .orderBy(F.col(prob).desc(), F.col("id_number").asc())
        .limit(n)
        .select(*cols)
    )


def marginal_cases(scored: DataFrame, prob: str = D.P, d: Decisions = Decisions()) -> DataFrame:
    """Rows with 0.4 < p < 0.6 (both strict)."""
    cols = [c for c in ("id_number", prob, "recommendation") if c in scored.columns]
    p = F.col(prob)
    return scored.where((p > dbl(d.marginal_low)) & (p < dbl(d.marginal_high))).select(*cols)


def elimination_report(scored: DataFrame, decision_col: str = "predicted_elimination") -> dict[str, DataFrame]:
    """Every section as a lazy DataFrame over the same scored frame.

    Callers that evaluate several sections should ``persist()`` the scored
    frame first (and ``unpersist()`` after) so the scan and join run once.
    """
    return {
        "summary": report_summary(scored, decision_col),
        "confidence_distribution": confidence_distribution(scored),
        "elimination_by_commodity": eliminations_by(scored, "commodity", decision_col),
        "elimination_by_feature": eliminations_by(scored, "feature_type", decision_col),
        "top_elimination_candidates": top_elimination_candidates(scored, 20, decision_col),
        "marginal_cases": marginal_cases(scored),
    }


def report_counts(scored: DataFrame, decision_col: str = "predicted_elimination", prob: str = D.P,
                  d: Decisions = Decisions()) -> DataFrame:
    """P7 as one tidy frame (section, key, value) of all count sections.

    One aggregation with grouping sets (), (confidence), (commodity),
    (feature type) over the scored frame; the tidy rows are derived from the
    grouped result (a few dozen rows).
    """
    is_elim, is_keep = _decided(scored, decision_col)
    p = F.col(prob)
    keys = ["confidence_level", "commodity", "feature_type"]
    g = scored.groupingSets([[], ["confidence_level"], ["commodity"], ["feature_type"]], *keys).agg(
        F.count(F.lit(1)).alias("n_all"),
        count_if(is_elim).alias("n_elim"),
        count_if(is_keep).alias("n_keep"),
        count_if((p > dbl(d.marginal_low)) & (p < dbl(d.marginal_high))).alias("n_marg"),
        F.grouping_id().alias("_gid"),
    ).withColumn("_pct", F.try_divide(F.col("n_elim") * dbl(100.0), F.col("n_all")))

    def row(section, key, value):
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"),
                        value.cast("double").alias("value"))

    entries = (
        F.when(F.col("_gid") == 7, F.array(
            row("summary", F.lit("total_cmls"), F.col("n_all")),
            row("summary", F.lit("recommended_eliminations"), F.col("n_elim")),
            row("summary", F.lit("recommended_keep"), F.col("n_keep")),
            row("summary", F.lit("elimination_rate"), py_round("_pct", 1)),
            row("sizes", F.lit("marginal_cases"), F.col("n_marg")),
        ))
        .when((F.col("_gid") == 3) & F.col("confidence_level").isNotNull(),
              F.array(row("confidence_distribution", F.col("confidence_level"), F.col("n_all"))))
        .when((F.col("_gid") == 5) & F.col("commodity").isNotNull() & (F.col("n_elim") > 0),
              F.array(row("elimination_by_commodity", F.col("commodity"), F.col("n_elim"))))
        .when((F.col("_gid") == 6) & F.col("feature_type").isNotNull() & (F.col("n_elim") > 0),
              F.array(row("elimination_by_feature", F.col("feature_type"), F.col("n_elim"))))
    )
    return g.select(F.explode(entries).alias("e")).select("e.section", "e.key", "e.value")
