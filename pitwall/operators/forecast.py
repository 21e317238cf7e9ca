"""Remaining-life forecasts and inspection schedules.

All transforms are narrow projections over the input (no shuffle); summaries
are single aggregations with partial (map-side) combine; top-k uses
``orderBy(...).limit(n)`` which plans as a per-partition top-k merge.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.core import count_if, dbl, missing, normalise, py_round, r6
from ..schema import RISK_LEVELS, ForecastA, ForecastB

B_OUTPUT = (
    "remaining_life_years",
    "next_inspection_date",
    "recommended_inspection_frequency_months",
    "estimated_thickness_at_next_inspection",
    "risk_level",
    "current_thickness_mm",
    "corrosion_rate_mm_per_year",
)


def ensure_ids(df: DataFrame, prefix: str = "CML-", id_col: str = "id_number") -> DataFrame:
    """Give a table without ids one id per row (quirk: the original used row positions).

    Spark rows have no position, and consecutive numbering would need a global
    sort into one task; ``monotonically_increasing_id`` is unique, computed
    per partition without a shuffle, and repeatable for the same input files.
    """
    if id_col in df.columns:
        return df
    return df.withColumn(id_col, F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string")))


def output_column(df: DataFrame, name: str, source: str = "forecast"):
    """The forecast's column ``name``, or with ``source="input"`` the one the input brought.

    A forecast of a table that already had the column carries both: the input's
    under its name, the forecast's with the suffix ``_forecast``.  Dates that
    came as text are parsed, and malformed ones (``2028-00-08``) are NULL.
    """
    if source not in ("forecast", "input"):
        raise ValueError("source must be 'forecast' or 'input'")
    both = f"{name}_forecast" in df.columns
    chosen = f"{name}_forecast" if both and source == "forecast" else name
    if name.endswith("_date") and dict(df.dtypes)[chosen] == "string":
        return F.try_to_date(F.col(chosen))
    return F.col(chosen)


def forecast_b(df: DataFrame, *, as_of: _dt.date, profile: ForecastB = ForecastB(),
               minimum_thickness: float | None = None, thickness: str = "thickness_mm",
               rate: str = "average_corrosion_rate", last_date: str = "last_inspection_date") -> DataFrame:
    """Profile-B forecast columns added to every input row.

    Rows are preserved one for one (the original's join back on id multiplied
    duplicate ids).  Output names that already exist in the input keep the
    input values; the new values get the suffix ``_forecast``
    (:func:`output_column` picks one).  NaN inputs count as NULL.
    """
    df = normalise(df)
    t, r = F.col(thickness), F.col(rate)
    last = F.col(last_date) if last_date in df.columns else F.lit(None).cast("date")
    if last_date in df.columns and dict(df.dtypes)[last_date] == "string":
        last = F.try_to_date(last)
    minimum = profile.minimum_thickness if minimum_thickness is None else minimum_thickness
    life = R.life_capped(t, r, minimum, profile.life_cap)
    months = R.interval_months_b(F.col("_life"), r, profile)
    values = {
        "remaining_life_years": py_round("_life", 1),
        "next_inspection_date": R.next_date_b(last, F.col("_months"), as_of, profile),
        "recommended_inspection_frequency_months": F.col("_months"),
        "estimated_thickness_at_next_inspection": py_round("_thick", 2),
        "risk_level": R.risk_level_b(F.col("_life"), r, t, profile),
        "current_thickness_mm": t,
        "corrosion_rate_mm_per_year": r,
    }
    out = df.withColumn("_life", life).withColumn("_months", months)
    out = out.withColumn("_thick", R.future_thickness_b(t, r, F.col("_months")))
    named = {}
    for name, expr in values.items():
        named[f"{name}_forecast" if name in df.columns else name] = expr
    return out.withColumns(named).drop("_life", "_months", "_thick")


MAX_PROFILES = 1_000


def profile_table(spark, profiles: list[tuple[str, ForecastB]]) -> DataFrame:
    """Named profiles as a table: ``profile`` and a column for each parameter."""
    kinds = {int: "long", float: "double"}
    names = [f.name for f in fields(ForecastB)]
    ddl = ", ".join(["profile string", *[f"{n} {kinds[type(getattr(ForecastB(), n))]}" for n in names]])
    kind = {n: type(getattr(ForecastB(), n)) for n in names}
    return spark.createDataFrame([(name, *[kind[n](getattr(p, n)) for n in names]) for name, p in profiles], ddl)


def forecast_profiles(df: DataFrame, profiles: DataFrame, *, as_of: _dt.date, **columns) -> DataFrame:
    """The forecast of every row under every profile of a table, keyed by ``profile``, in one pass over ``df``.

    The table (``profile_table``) has at most ``MAX_PROFILES`` rows and travels as
    a literal; the rules read a row's parameters from it.  Null parameters give
    null results; no profiles give no rows.  A column ``profile`` of ``df`` is
    replaced.
    """
    found = profiles.limit(MAX_PROFILES + 1).collect()
    if len(found) > MAX_PROFILES:
        raise ValueError(f"at most {MAX_PROFILES} profiles")
    kinds = dict(profiles.dtypes)
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in profiles.columns]) for r in found])
    df = df.drop("profile")
    if not found:
        return forecast_b(df.limit(0), as_of=as_of, **columns).withColumn("profile", F.lit(None).cast("string"))
    name = "_profile"
    while name in df.columns:
        name += "_"
    rows = df.withColumn(name, F.explode(each))
    own = ForecastB(**{f.name: F.col(f"`{name}`.{f.name}") for f in fields(ForecastB)})
    return forecast_b(rows, as_of=as_of, profile=own, **columns).withColumn("profile", F.col(f"`{name}`.profile")).drop(name)


def risk_summary(fc: DataFrame, source: str = "forecast") -> DataFrame:
    """Points, mean / min life per risk level (the flagship query)."""
    life = output_column(fc, "remaining_life_years", source)
    return fc.groupBy(output_column(fc, "risk_level", source).alias("risk_level")).agg(
        F.count(F.lit(1)).alias("n_points"),
        r6(F.avg(life)).alias("avg_remaining_life_years"),
        F.min(life).alias("min_remaining_life_years"),
        F.max(output_column(fc, "recommended_inspection_frequency_months", source)).alias("max_interval_months"),
    )


def forecast_summary(fc: DataFrame, *, as_of: _dt.date, within_days: int = 365, source: str = "forecast") -> DataFrame:
    """One-row summary of a profile-B forecast.

    ``source`` says whose life and dates are summarised where the input had
    columns of the same names: the forecast's (default) or the input's.
    """
    life, risk = output_column(fc, "remaining_life_years", source), output_column(fc, "risk_level", source)
    due = output_column(fc, "next_inspection_date", source) <= F.date_add(F.lit(as_of), within_days)
    return fc.agg(
        F.count(F.lit(1)).alias("total_cmls"),
        *[count_if(risk == lvl).alias(f"n_{lvl.lower()}") for lvl in RISK_LEVELS],
        r6(F.avg(life)).alias("avg_remaining_life_years"),
        F.min(life).alias("min_remaining_life_years"),
        count_if(risk == "CRITICAL").alias("critical_cmls"),
        count_if(risk == "HIGH").alias("high_risk_cmls"),
        count_if(due).alias("inspections_needed_next_12_months"),
    )


def _picked(fc: DataFrame, source: str) -> list:
    return [output_column(fc, c, source).alias(c) for c in ("remaining_life_years", "next_inspection_date", "risk_level")]


def top_priority_inspections(fc: DataFrame, n: int = 10, source: str = "forecast") -> DataFrame:
    """C14: the n smallest lives (missing life excluded), ties by id.

    NULLs sort last and are dropped after the per-partition top-k, which
    gives the same rows as filtering first but filters at most n rows (a
    filter on the computed life would be pushed below its projection).
    """
    return (
        fc.select("id_number", *_picked(fc, source))
        .orderBy(F.col("remaining_life_years").asc_nulls_last(), F.col("id_number").asc())
        .limit(n)
        .where(F.col("remaining_life_years").isNotNull())
    )


def inspections_due(fc: DataFrame, *, as_of: _dt.date, within_days: int = 365, source: str = "forecast") -> DataFrame:
    """Points whose next inspection falls within ``within_days`` (last day included)."""
    picked = fc.select("id_number", *_picked(fc, source))
    return picked.where(F.col("next_inspection_date") <= F.date_add(F.lit(as_of), within_days)).select(
        "id_number", "next_inspection_date", "risk_level", "remaining_life_years"
    )


A_OUTPUT = (
    "id_number",
    "remaining_life_years",
    "next_inspection_date",
    "estimated_thickness_at_next_inspection",
    "recommended_inspection_frequency_months",
    "risk_level",
)


def _a_accepted(t, r, profile: ForecastA):
    ok = ~missing(t) & ~missing(r) & (t > dbl(0.0)) & (r >= dbl(0.0))
    return ok & F.lit(profile.safety_factor >= 1.0)


def forecast_a(df: DataFrame, *, as_of: _dt.date, profile: ForecastA = ForecastA(),
               thickness: str = "thickness_mm", rate: str = "average_corrosion_rate") -> DataFrame:
    """Profile-A schedule for accepted rows (t > 0, rate >= 0, sf >= 1).

    Rejected rows are skipped, as the original skipped rows whose schedule
    raised; :func:`forecast_a_rejects` returns them with a reason.
    """
    t, r = F.col(thickness), F.col(rate)
    acc = df.where(_a_accepted(t, r, profile))
    life = R.life_capped(t, r, profile.minimum_thickness, profile.life_cap)
    out = acc.withColumn("_life", life).withColumn("_years", R.interval_years_a(F.col("_life"), profile))
    out = out.withColumn("_thick", R.estimated_thickness_a(t, r, F.col("_years")))
    return out.select(
        "id_number",
        py_round("_life", 1).alias("remaining_life_years"),
        R.next_date_a(F.col("_years"), as_of, profile).alias("next_inspection_date"),
        py_round("_thick", 2).alias("estimated_thickness_at_next_inspection"),
        F.floor(F.col("_years") * dbl(12.0)).cast("int").alias("recommended_inspection_frequency_months"),
        R.risk_level_a(F.col("_life"), profile).alias("risk_level"),
    )


def forecast_a_rejects(df: DataFrame, *, profile: ForecastA = ForecastA(), thickness: str = "thickness_mm",
                       rate: str = "average_corrosion_rate") -> DataFrame:
    """Rows profile A refuses, with the first failing rule."""
    t, r = F.col(thickness), F.col(rate)
    reason = (
        F.when(missing(t), F.lit("thickness missing"))
        .when(missing(r), F.lit("corrosion rate missing"))
        .when(t <= dbl(0.0), F.lit("thickness must be positive"))
        .when(r < dbl(0.0), F.lit("corrosion rate must be non-negative"))
        .when(F.lit(profile.safety_factor < 1.0), F.lit("safety factor must be >= 1.0"))
    )
    return df.where(~_a_accepted(t, r, profile)).select("id_number", reason.alias("reject_reason"))
