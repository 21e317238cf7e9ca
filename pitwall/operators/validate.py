"""Validation of point tables and override logs.

Schema checks (V1, V2) run on the driver against ``df.columns`` or as one
``isEmpty`` probe; every data check is a single distributed aggregation that
returns a tiny tidy frame.  Example ids are the smallest offending ids
(``orderBy(id).limit(k)``, a per-partition top-k), since Spark rows carry no
file position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import count_if, dbl, literal_rows, missing, normalise
from ..schema import CML_SHAPES, FEATURE_TYPES, REQUIRED_POINT_COLUMNS, Validation
from .forecast import output_column


def check_not_empty(df: DataFrame) -> bool:
    """V1 (guard action): False when the table has no rows."""
    return not df.isEmpty()


def missing_columns(df: DataFrame, required=REQUIRED_POINT_COLUMNS) -> list[str]:
    """V2: sorted names of required columns absent from the schema."""
    return sorted(set(required) - set(df.columns))


def _examples(ids: DataFrame, k: int) -> DataFrame:
    """One-row frame: the k smallest ids joined by ', ' (NULL when none)."""
    top = ids.where(F.col("id_number").isNotNull()).orderBy("id_number").limit(k)
    return top.agg(F.array_join(F.sort_array(F.collect_list("id_number")), ", ").alias("examples"))


def duplicate_ids(df: DataFrame, p: Validation = Validation()) -> DataFrame:
    """V3: occurrences after the first per id (NULL ids repeat too) + examples.

    The per-id count is a partially aggregated groupBy, so a hot id costs one
    buffer per partition before the shuffle.
    """
    return duplicates_of(df.groupBy("id_number").agg(F.count(F.lit(1)).alias("c")), p)


def duplicates_of(counts: DataFrame, p: Validation = Validation()) -> DataFrame:
    """V3 from ``counts``: a row per id with its occurrences ``c``."""
    dups = counts.where(F.col("c") > 1)
    ex = _examples(dups.select("id_number"), p.duplicate_examples)
    total = counts.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))
    return total.select("n_duplicates", F.when(F.col("n_duplicates") > 0, ex.scalar()).alias("examples"))


def null_counts(df: DataFrame, columns=REQUIRED_POINT_COLUMNS) -> DataFrame:
    """V4: missing values (NULL or NaN) per column, only columns with at least one (tidy)."""
    df = normalise(df)
    cols = [c for c in columns if c in df.columns]
    wide = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in cols])
    tidy = wide.unpivot([], cols, "column_name", "null_count")
    return tidy.where(F.col("null_count") > 0)


def _range_violations(df: DataFrame, bad, k: int) -> DataFrame:
    df = normalise(df)
    hits = df.where(bad)
    ex = _examples(hits.select("id_number"), k)
    return df.agg(count_if(bad).alias("n_violations")).select(
        "n_violations", F.when(F.col("n_violations") > 0, ex.scalar()).alias("examples"))


def corrosion_range_violations(df: DataFrame, lo: float = 0.0, hi: float = 5.0,
                               p: Validation = Validation()) -> DataFrame:
    """V5: rate < lo or rate > hi (NULL passes), count + 3 example ids."""
    r = F.col("average_corrosion_rate")
    return _range_violations(df, (r < dbl(lo)) | (r > dbl(hi)), p.range_examples)


def thickness_range_violations(df: DataFrame, lo: float = 0.0, hi: float = 50.0,
                               p: Validation = Validation()) -> DataFrame:
    """V6: t <= lo or t > hi (NULL passes), count + 3 example ids."""
    t = F.col("thickness_mm")
    return _range_violations(df, (t <= dbl(lo)) | (t > dbl(hi)), p.range_examples)


def dataset_profile(df: DataFrame) -> DataFrame:
    """V7: rows, distinct non-null ids, mean / min / max of rate and thickness."""
    r, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct("id_number").alias("unique_cmls"),
        F.round(F.avg(r), 6).alias("avg_corrosion_rate"),
        F.round(F.avg(t), 6).alias("avg_thickness"),
        F.min(r).alias("min_corrosion_rate"), F.max(r).alias("max_corrosion_rate"),
        F.min(t).alias("min_thickness"), F.max(t).alias("max_thickness"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """V8 / V9: count per value, NULL dropped."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_points"))
    )


def _reasons(checks) -> F.Column:
    """'; '-joined failed-rule messages (NULL when every rule passes)."""
    parts = [F.when(cond, F.lit(msg)) for cond, msg in checks]
    any_fail = None
    for cond, _msg in checks:
        c = F.coalesce(cond, F.lit(False))
        any_fail = c if any_fail is None else (any_fail | c)
    return F.when(any_fail, F.concat_ws("; ", *parts))


def point_contract_reasons(df: DataFrame, p: Validation = Validation()) -> F.Column:
    r, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    checks = [
        (F.col("id_number").isNull(), "id_number missing"),
        (missing(r), "average_corrosion_rate missing"),
        (~missing(r) & ((r < dbl(p.min_rate)) | (r > dbl(p.max_rate))), "average_corrosion_rate out of range"),
        (missing(t), "thickness_mm missing"),
        (~missing(t) & ((t <= dbl(p.min_thickness)) | (t > dbl(p.max_thickness))), "thickness_mm out of range"),
        (F.col("commodity").isNull() | (F.length("commodity") < 1), "commodity empty"),
        (F.col("feature_type").isNull(), "feature_type missing"),
        (F.col("cml_shape").isNull(), "cml_shape missing"),
    ]
    if "remaining_life_years" in df.columns:
        checks.append((F.col("remaining_life_years") < dbl(0.0), "remaining_life_years negative"))
    if "risk_score" in df.columns:
        rs = F.col("risk_score")
        checks.append(((rs < dbl(0.0)) | (rs > dbl(p.max_risk_score)), "risk_score out of range"))
    return _reasons(checks)


def row_contract_split(df: DataFrame, p: Validation = Validation()) -> DataFrame:
    """Every row with ``is_valid`` and the failed rules (quarantine = not valid)."""
    reasons = point_contract_reasons(df, p)
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.col("reasons").isNull())


def override_contract_split(log: DataFrame, p: Validation = Validation()) -> DataFrame:
    """Decision KEEP|ELIMINATE, reason >= min length, probability in [0, 1]."""
    prob = F.col("original_probability")
    checks = [
        (F.col("id_number").isNull(), "id_number missing"),
        (F.coalesce(~F.col("sme_decision").rlike("^(KEEP|ELIMINATE)$"), F.lit(True)), "sme_decision invalid"),
        (F.coalesce(F.length("reason") < p.min_reason_len, F.lit(True)), "reason too short"),
        (F.col("sme_name").isNull(), "sme_name missing"),
        ((prob < dbl(0.0)) | (prob > dbl(1.0)), "original_probability out of range"),
    ]
    return log.withColumn("reasons", _reasons(checks)).withColumn("is_valid", F.col("reasons").isNull())


def domain_check(df: DataFrame, feature_types=FEATURE_TYPES, shapes=CML_SHAPES) -> DataFrame:
    """V12 (report only): values outside the feature-type and shape enumerations."""
    tidy = df.select(
        F.explode(F.array(
            F.struct(F.lit("feature_type").alias("column_name"), F.col("feature_type").alias("value"),
                     (~F.col("feature_type").isin(*feature_types)).alias("bad")),
            F.struct(F.lit("cml_shape").alias("column_name"), F.col("cml_shape").alias("value"),
                     (~F.col("cml_shape").isin(*shapes)).alias("bad")),
        )).alias("v")
    ).select("v.*")
    return tidy.where(F.col("bad")).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_points"))


def _report_counts(df: DataFrame, cols, rate_bad, thick_bad) -> DataFrame:
    """One row: every count and statistic of the report, in one pass (per id, then over all)."""
    r, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    sums = {f"nulls:{c}": F.col(c).isNull() for c in cols} | {"corrosion_range": rate_bad, "thickness_range": thick_bad}
    per_id = df.groupBy("id_number").agg(
        F.count(F.lit(1)).alias("_c"), *[count_if(c).alias(n) for n, c in sums.items()],
        F.sum(r).alias("_sr"), F.count(r).alias("_nr"), F.min(r).alias("_lr"), F.max(r).alias("_hr"),
        F.sum(t).alias("_st"), F.count(t).alias("_nt"), F.min(t).alias("_lt"), F.max(t).alias("_ht"))
    text = lambda c: F.format_string("%.6f", F.round(c, 6))
    return per_id.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("total_records"),
        F.count("id_number").alias("unique_cmls"),
        F.sum(F.col("_c") - 1).alias("duplicate_ids"),
        *[F.sum(f"`{n}`").alias(n) for n in sums],
        text(F.try_divide(F.sum("_sr"), F.sum("_nr"))).alias("avg_corrosion_rate"),
        text(F.try_divide(F.sum("_st"), F.sum("_nt"))).alias("avg_thickness"),
        text(F.min("_lr")).alias("min_corrosion_rate"), text(F.max("_hr")).alias("max_corrosion_rate"),
        text(F.min("_lt")).alias("min_thickness"), text(F.max("_ht")).alias("max_thickness"),
    )


def _report_examples(df: DataFrame, rate_bad, thick_bad, p: Validation) -> DataFrame:
    """(check_name, examples): the smallest offending ids of every rule, in one pass."""
    per_id = df.where(F.col("id_number").isNotNull()).groupBy("id_number").agg(
        F.count(F.lit(1)).alias("c"), count_if(rate_bad).alias("r"), count_if(thick_bad).alias("t"))
    k = p.range_examples
    hits = F.array(
        F.struct(F.lit("duplicate_ids").alias("check_name"), F.when(F.col("c") > 1, 1).otherwise(0).alias("times"),
                 F.lit(p.duplicate_examples).alias("k")),
        F.struct(F.lit("corrosion_range").alias("check_name"), F.least("r", F.lit(k)).cast("int").alias("times"), F.lit(k).alias("k")),
        F.struct(F.lit("thickness_range").alias("check_name"), F.least("t", F.lit(k)).cast("int").alias("times"), F.lit(k).alias("k")),
    )
    tagged = per_id.select("id_number", F.explode(F.filter(hits, lambda h: h["times"] > 0)).alias("h"))
    rows = tagged.select("h.check_name", "h.k", F.explode(F.array_repeat("id_number", F.col("h.times"))).alias("id_number"))
    rank = F.row_number().over(Window.partitionBy("check_name").orderBy("id_number"))  # limited before the shuffle
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(k, p.duplicate_examples)).where(F.col("rank") <= F.col("k"))
    return top.groupBy("check_name").agg(F.array_join(F.sort_array(F.collect_list("id_number")), ", ").alias("examples"))


def validation_report(df: DataFrame, p: Validation = Validation(), rate_range=(0.0, 5.0),
                      thickness_range=(0.0, 50.0), required=REQUIRED_POINT_COLUMNS) -> DataFrame:
    """Tidy (severity, check_name, n, detail) rows.

    Only an empty table or missing columns make the table invalid (and stop
    further checks, as the original did); the rest are warnings and, as
    'info', the statistics V7-V9.  The row ('info', 'valid') carries 1 for
    valid and 0 for invalid.  Three passes: counts, examples, distributions.
    """
    schema = "severity string, check_name string, n bigint, detail string"
    absent = missing_columns(df, required)
    if absent:
        return literal_rows(
            df.sparkSession, [("error", "missing_columns", len(absent), ", ".join(absent)), ("info", "valid", 0, None)], schema)
    df = normalise(df)
    r, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    rate_bad = (r < dbl(rate_range[0])) | (r > dbl(rate_range[1]))
    thick_bad = (t <= dbl(thickness_range[0])) | (t > dbl(thickness_range[1]))
    cols = [c for c in required if c in df.columns]
    one = _report_counts(df, cols, rate_bad, thick_bad)
    entry = lambda severity, name, n, detail=None: F.struct(
        F.lit(severity).alias("severity"), F.lit(name).alias("check_name"), n.cast("bigint").alias("n"),
        (F.lit(None).cast("string") if detail is None else detail).alias("detail"))
    total = F.col("total_records")
    warnings = ["duplicate_ids", *[f"nulls:{c}" for c in cols], "corrosion_range", "thickness_range"]
    averages = ["avg_corrosion_rate", "avg_thickness", "min_corrosion_rate", "max_corrosion_rate", "min_thickness", "max_thickness"]
    empty = F.array(entry("error", "empty", F.lit(0), F.lit("DataFrame is empty")), entry("info", "valid", F.lit(0)))
    found = F.concat(
        F.filter(F.array(*[entry("warning", n, F.col(f"`{n}`")) for n in warnings]), lambda x: x["n"] > 0),
        F.array(entry("info", "valid", F.lit(1)), entry("info", "total_records", total), entry("info", "unique_cmls", F.col("unique_cmls")),
                *[entry("info", n, F.lit(None), F.col(n)) for n in averages]))
    rows = one.select(F.explode(F.when(total == 0, empty).otherwise(found)).alias("e")).select("e.*")
    examples = _report_examples(df, rate_bad, thick_bad, p)
    rows = rows.join(examples, "check_name", "left").select(
        "severity", "check_name", "n", F.coalesce("detail", "examples").alias("detail"))
    by_value = df.groupingSets([["commodity"], ["feature_type"]], "commodity", "feature_type").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("commodity").alias("g"))
    value = F.when(F.col("g") == 0, F.col("commodity")).otherwise(F.col("feature_type"))
    kinds = by_value.where(value.isNotNull()).select(
        F.lit("info").alias("severity"),
        F.concat(F.when(F.col("g") == 0, F.lit("commodity:")).otherwise(F.lit("feature_type:")), value).alias("check_name"),
        F.col("n").cast("bigint").alias("n"), F.lit(None).cast("string").alias("detail"))
    return rows.unionByName(kinds)


def forecast_contract_split(fc: DataFrame, p: Validation = Validation(), minimum_thickness: float = 3.0,
                            interval_months: int = 12, source: str = "forecast") -> DataFrame:
    """Forecast input and output contract per row (plus parameter checks).

    ``source`` says whose outputs are judged where the input had its own.
    """
    r, t = F.col("average_corrosion_rate"), F.col("thickness_mm")
    life = output_column(fc, "remaining_life_years", source)
    months = output_column(fc, "recommended_inspection_frequency_months", source)
    checks = [
        (missing(r) | (r < dbl(0.0)), "corrosion rate must be >= 0"),
        (missing(t) | (t <= dbl(0.0)), "thickness must be > 0"),
        (F.lit(minimum_thickness <= 0), "minimum thickness must be > 0"),
        (F.lit(not (p.min_forecast_interval <= interval_months <= p.max_forecast_interval)),
         "interval must be within 1..120 months"),
        (missing(life) | (life < dbl(0.0)), "remaining life must be >= 0"),
        (months.isNull() | (months < 1), "frequency must be >= 1"),
    ]
    return fc.withColumn("reasons", _reasons(checks)).withColumn("is_valid", F.col("reasons").isNull())

