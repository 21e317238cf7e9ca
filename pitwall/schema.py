"""Schemas, fixed domain values and the named threshold profiles.

The business terms (remaining life, risk level, confidence, ...) have several
conflicting definitions in the original application.  Each definition lives in
its own frozen dataclass below and operators take the profile as a parameter,
so two definitions are never blended inside one computation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# These must equal the original application's values for the
# results to agree.  Listed in their natural order.
# --------------------------------------------------------------------------
COMMODITIES = (
    "Crude Oil",
    "Natural Gas",
    "Steam",
    "Fuel Gas",
    "Potable Water",
    "Process Water",
    "Condensate",
    "Refined Product",
    "Gas",
)
FEATURE_TYPES = ("Pipe", "Elbow", "Tee", "Reducer", "Flange", "Nozzle", "Header", "Bend", "Weld")
CML_SHAPES = ("Internal", "External", "Both")
RISK_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
DECISIONS = ("KEEP", "ELIMINATE")
REMOVED = "REMOVED"  # decision of a tombstone row in the override log

# Required column lists (validation V2 variants).
REQUIRED_POINT_COLUMNS = (
    "id_number",
    "average_corrosion_rate",
    "thickness_mm",
    "commodity",
    "feature_type",
    "cml_shape",
)
REQUIRED_TRAINING_COLUMNS = REQUIRED_POINT_COLUMNS[1:] + ("elimination_flag",)
REQUIRED_POINT_COLUMNS_WITH_DATES = REQUIRED_POINT_COLUMNS + ("last_inspection_date", "next_inspection_date")

# Right-closed bins (lo, hi]; hi None = +infinity.  Labels are display values.
RISK_BAND_4 = ((0.0, 2.0, "CRITICAL"), (2.0, 5.0, "HIGH"), (5.0, 10.0, "MEDIUM"), (10.0, None, "LOW"))
RISK_BAND_5 = (
    (0.0, 2.0, "CRITICAL"),
    (2.0, 5.0, "HIGH"),
    (5.0, 10.0, "MEDIUM"),
    (10.0, 20.0, "LOW"),
    (20.0, None, "MINIMAL"),
)
CORROSION_BINS = (
    (0.0, 0.05, "<0.05"),
    (0.05, 0.10, "0.05-0.10"),
    (0.10, 0.15, "0.10-0.15"),
    (0.15, 0.20, "0.15-0.20"),
    (0.20, None, ">0.20"),
)
THICKNESS_BINS = (
    (0.0, 5.0, "<5mm"),
    (5.0, 7.0, "5-7mm"),
    (7.0, 9.0, "7-9mm"),
    (9.0, 11.0, "9-11mm"),
    (11.0, None, ">11mm"),
)
INSPECTION_TIME_BINS = (
    (0.0, 6.0, "0-6mo"),
    (6.0, 12.0, "6-12mo"),
    (12.0, 24.0, "1-2yr"),
    (24.0, 36.0, "2-3yr"),
    (36.0, 72.0, "3-6yr"),
    (72.0, None, ">6yr"),
)
# Gauge colour steps (half-open [lo, hi)); upper bounds of all but the last step.
LIFE_GAUGE_STEPS = (5.0, 15.0, 30.0)
CRITICAL_PCT_GAUGE_STEPS = (5.0, 15.0)
RATE_GAUGE_STEPS = (0.1, 0.2)
CRITICAL_PCT_ALERT = 10.0

# Synthetic generator: corrosion-rate range per commodity group and
# thickness range per feature group.
GEN_RATE_RANGES = (
    (("Crude Oil", "Condensate"), 0.05, 0.20),
    (("Natural Gas", "Fuel Gas", "Gas"), 0.03, 0.15),
    (("Steam",), 0.08, 0.25),
)
GEN_RATE_DEFAULT = (0.02, 0.12)  # water types
GEN_THICKNESS_RANGES = (
    (("Header", "Pipe"), 8.0, 12.0),
    (("Flange", "Reducer"), 9.0, 11.5),
)
GEN_THICKNESS_DEFAULT = (6.0, 10.5)


# --------------------------------------------------------------------------
# Named threshold profiles.
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class ForecastB:
    """Forecaster profile B: life capped at 50, months clamped 12..72."""

    minimum_thickness: float = 3.0
    safety_factor: float = 1.5
    min_interval_months: int = 12
    max_interval_months: int = 72
    life_cap: float = 50.0
    fast_rate: float = 0.20
    slow_rate: float = 0.05
    fast_factor: float = 0.7
    slow_factor: float = 1.3
    # 30.44 days per month, kept as an exact ratio of integers.
    month_days_num: int = 3044
    month_days_den: int = 100
    critical_life: float = 1.0
    critical_thickness: float = 5.0
    high_life: float = 3.0
    high_rate: float = 0.25
    medium_life: float = 7.0
    medium_rate: float = 0.15


@dataclass(frozen=True)
class ForecastA:
    """Schedule profile A: interval in years clamped 1..6, 0.5 for life 0."""

    minimum_thickness: float = 3.0
    safety_factor: float = 1.5
    min_interval_years: float = 1.0
    max_interval_years: float = 6.0
    zero_life_interval_years: float = 0.5
    life_cap: float = 50.0
    days_per_year: int = 365
    critical_life: float = 2.0
    high_life: float = 5.0
    medium_life: float = 10.0


@dataclass(frozen=True)
class Analytics:
    """Portfolio analytics: life from raw with the rate floored at 0.01."""

    minimum_thickness: float = 3.0
    rate_floor: float = 0.01
    life_cap: float = 50.0
    interval_factor: float = 1.5
    max_interval_years: float = 6.0
    zero_life_interval_years: float = 0.5
    high_corrosion: float = 0.15
    dashboard_high_corrosion: float = 0.20
    below_min_thickness: float = 3.0
    thin_wall: float = 5.0
    critical_life: float = 2.0
    histogram_bins: int = 20


@dataclass(frozen=True)
class Validation:
    min_rate: float = 0.0
    max_rate: float = 5.0
    min_thickness: float = 0.0  # exclusive
    max_thickness: float = 50.0
    max_risk_score: float = 100.0
    duplicate_examples: int = 5
    range_examples: int = 3
    min_reason_len: int = 10
    min_forecast_interval: int = 1
    max_forecast_interval: int = 120


@dataclass(frozen=True)
class Features:
    minimum_thickness: float = 3.0
    high_corrosion: float = 0.15
    thin_wall: float = 8.0
    low_life: float = 10.0
    default_days_since: int = 365
    risk_rate_weight: float = 20.0
    risk_thickness_weight: float = 5.0
    risk_thickness_ref: float = 10.0
    risk_max: float = 100.0


@dataclass(frozen=True)
class Decisions:
    threshold: float = 0.5
    two_level_margin: float = 0.3
    high_confidence: float = 0.8
    medium_confidence: float = 0.6
    marginal_low: float = 0.4
    marginal_high: float = 0.6
    cost_per_inspection: int = 500
    inspections_per_year: int = 2


# --------------------------------------------------------------------------
# Struct types.
# --------------------------------------------------------------------------
POINT_SCHEMA = T.StructType(
    [
        T.StructField("id_number", T.StringType()),
        T.StructField("average_corrosion_rate", T.DoubleType()),
        T.StructField("thickness_mm", T.DoubleType()),
        T.StructField("commodity", T.StringType()),
        T.StructField("feature_type", T.StringType()),
        T.StructField("cml_shape", T.StringType()),
        T.StructField("last_inspection_date", T.StringType()),
        T.StructField("next_inspection_date", T.StringType()),
        T.StructField("remaining_life_years", T.DoubleType()),
        T.StructField("days_to_next_inspection", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("elimination_flag", T.IntegerType()),
    ]
)

OVERRIDE_SCHEMA = T.StructType(
    [
        T.StructField("id_number", T.StringType()),
        T.StructField("sme_decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("sme_name", T.StringType()),
        T.StructField("override_date", T.TimestampNTZType()),
        T.StructField("original_prediction", T.StringType()),
        T.StructField("original_probability", T.DoubleType()),
    ]
)
