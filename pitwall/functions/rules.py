"""Scalar business rules as Spark Column expressions.

Every function takes and returns ``Column`` objects, so the rules compile into
whole-stage generated code; there is no Python UDF anywhere in the package.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import Analytics, Decisions, Features, ForecastA, ForecastB
from .core import clip, dbl, missing, null_double, trunc_int

# ---------------------------------------------------------------- life rules


def life_capped(t: Column, rate: Column, minimum: float | Column, cap: float = 50.0) -> Column:
    """T-min <= 0 -> 0; rate <= 0 -> cap; else min((t-min)/rate, cap).

    Test order matters and is kept: a thin wall gives 0 even at rate 0.
    Any NULL or NaN input gives NULL (safer than the original, see README).
    """
    minimum = minimum if isinstance(minimum, Column) else dbl(minimum)
    avail = t - minimum
    return (
        F.when(missing(t) | missing(rate), null_double())
        .when(avail <= 0, dbl(0.0))
        .when(rate <= 0, dbl(cap))
        .otherwise(F.least(avail / rate, dbl(cap)))
    )


def life_uncapped(t: Column, rate: Column, minimum: float = 3.0) -> Column:
    """max(0, (t-min)/rate) with no upper cap; rate 0 gives NULL."""
    raw = F.try_divide(t - dbl(minimum), rate)
    return clip(F.when(rate == 0, null_double()).otherwise(raw), lo=0.0)


def life_analytics(t: Column, rate: Column, p: Analytics = Analytics(), lo: float | None = 0.0,
                   hi: float | None = None) -> Column:
    """Portfolio life: (t - 3) / max(rate, 0.01), then clipped to [lo, hi]."""
    raw = (t - dbl(p.minimum_thickness)) / clip(rate, lo=p.rate_floor)
    return clip(raw, lo=lo, hi=hi)


# ------------------------------------------------------------ profile B


def interval_months_b(life: Column, rate: Column, p: ForecastB = ForecastB()) -> Column:
    """int(life / sf * 12), x0.7 if rate > .20, x1.3 if rate < .05, clamp."""
    m0 = F.floor(life / dbl(p.safety_factor) * dbl(12.0))
    m1 = (
        F.when(rate > dbl(p.fast_rate), F.floor(m0 * dbl(p.fast_factor)))
        .when(rate < dbl(p.slow_rate), F.floor(m0 * dbl(p.slow_factor)))
        .otherwise(m0)
    )
    clamped = F.least(F.greatest(m1, F.lit(p.min_interval_months).cast("bigint")),
                      F.lit(p.max_interval_months).cast("bigint"))
    return F.when(missing(life) | missing(rate), F.lit(None).cast("bigint")).otherwise(clamped).cast("int")


def next_date_b(last: Column, months: Column, as_of: _dt.date, p: ForecastB = ForecastB()) -> Column:
    """Last (or as_of) + floor(months * 30.44) days, in exact integers."""
    days = F.floor((months.cast("bigint") * F.lit(p.month_days_num)) / F.lit(p.month_days_den)).cast("int")
    base = F.coalesce(last.cast("date"), F.lit(as_of))
    return F.when(months.isNull(), F.lit(None).cast("date")).otherwise(F.date_add(base, days))


def future_thickness_b(t: Column, rate: Column, months: Column) -> Column:
    """C4: max(0, t - rate * months / 12)."""
    years = months.cast("double") / dbl(12.0)
    return clip(t - rate * years, lo=0.0)


def risk_level_b(life: Column, rate: Column, t: Column, p: ForecastB = ForecastB()) -> Column:
    """C5 on the unrounded life."""
    return (
        F.when(missing(life) | missing(rate) | missing(t), F.lit(None).cast("string"))
        .when((life < dbl(p.critical_life)) | (t < dbl(p.critical_thickness)), F.lit("CRITICAL"))
        .when((life < dbl(p.high_life)) | (rate > dbl(p.high_rate)), F.lit("HIGH"))
        .when((life < dbl(p.medium_life)) | (rate > dbl(p.medium_rate)), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


# ------------------------------------------------------------ profile A


def interval_years_a(life: Column, p: ForecastA = ForecastA()) -> Column:
    """Life 0 -> 0.5 year, else clamp(life / sf, 1, 6)."""
    return F.when(missing(life), null_double()).when(life == 0, dbl(p.zero_life_interval_years)).otherwise(
        F.greatest(dbl(p.min_interval_years), F.least(life / dbl(p.safety_factor), dbl(p.max_interval_years)))
    )


def next_date_a(years: Column, as_of: _dt.date, p: ForecastA = ForecastA()) -> Column:
    """as_of + int(years * 365) days."""
    return F.date_add(F.lit(as_of), trunc_int(years * F.lit(p.days_per_year)).cast("int"))


def risk_level_a(life: Column, p: ForecastA = ForecastA()) -> Column:
    """Life-only thresholds 2 / 5 / 10."""
    return (
        F.when(missing(life), F.lit(None).cast("string"))
        .when(life < dbl(p.critical_life), F.lit("CRITICAL"))
        .when(life < dbl(p.high_life), F.lit("HIGH"))
        .when(life < dbl(p.medium_life), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )


def estimated_thickness_a(t: Column, rate: Column, years: Column) -> Column:
    """C11: t - rate * years; may be negative."""
    return t - rate * years


# ------------------------------------------------------------------ analytics


def analytics_interval_months(life: Column, p: Analytics = Analytics()) -> Column:
    """x > 0 ? min(x / 1.5, 6) : 0.5, in months.  A missing life counts as 0.5 year."""
    years = F.when(~missing(life) & (life > 0), F.least(life / dbl(p.interval_factor), dbl(p.max_interval_years))).otherwise(
        dbl(p.zero_life_interval_years)
    )
    return years * dbl(12.0)


# ------------------------------------------------------------------ features


def risk_score_fallback(t: Column, rate: Column, p: Features = Features()) -> Column:
    """clip(20 * rate + 5 * (10 - t), 0, 100)."""
    raw = rate * dbl(p.risk_rate_weight) + (dbl(p.risk_thickness_ref) - t) * dbl(p.risk_thickness_weight)
    return clip(raw, lo=0.0, hi=p.risk_max)


# ------------------------------------------------------------------ decisions


def decision_flag(prob: Column, p: Decisions = Decisions()) -> Column:
    """1 when p > 0.5 (0.5 itself keeps)."""
    return F.when(missing(prob), F.lit(None).cast("int")).when(prob > dbl(p.threshold), F.lit(1)).otherwise(F.lit(0))


def recommendation(flag: Column) -> Column:
    return F.when(flag == 1, F.lit("ELIMINATE")).when(flag == 0, F.lit("KEEP")).otherwise(F.lit(None).cast("string"))


def confidence_two_level(prob: Column, p: Decisions = Decisions()) -> Column:
    """D3: abs(p - 0.5) > 0.3 -> HIGH else MODERATE."""
    return F.when(missing(prob), F.lit(None).cast("string")).when(
        F.abs(prob - dbl(0.5)) > dbl(p.two_level_margin), F.lit("HIGH")
    ).otherwise(F.lit("MODERATE"))


def confidence_score(prob: Column) -> Column:
    """D4 numeric confidence: max(p, 1 - p)."""
    return F.when(missing(prob), null_double()).otherwise(F.greatest(prob, dbl(1.0) - prob))


def confidence_three_level(prob: Column, p: Decisions = Decisions()) -> Column:
    """max(p, 1-p) > 0.8 HIGH, > 0.6 MEDIUM, else LOW."""
    c = confidence_score(prob)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c > dbl(p.high_confidence), F.lit("HIGH"))
        .when(c > dbl(p.medium_confidence), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
