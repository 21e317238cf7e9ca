"""Contracts as data: rules read from a table, compiled into one projection.

A rule table has the columns ``contract``, ``rule`` (its name), ``column_name``,
``op``, ``bound`` (text) and ``severity``.  Ops: ``required`` (not null, NaN
counts as null), ``min`` / ``max`` (violated below / above), ``above`` (violated
at or below), ``one_of`` (values separated by ``|``; null violates), ``min_length``
(null violates), ``date`` (a text that is no date; null passes) and ``present``
(the table must have the column).  A rule about an absent column, other than
``present``, holds vacuously.  Rule tables are small: they are read on the driver,
at most ``MAX_RULES`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import dbl, missing
from ..schema import CML_SHAPES, FEATURE_TYPES, REQUIRED_POINT_COLUMNS

MAX_RULES = 10_000
RULE_COLUMNS = ("contract", "rule", "column_name", "op", "bound", "severity")

# The names that the original's checks require: training data, scoring input, forecast input.
TRAINING = ("id_number", "average_corrosion_rate", "thickness_mm", "commodity", "feature_type", "cml_shape", "elimination_flag", "last_inspection_date")
FORECAST = ("id_number", "average_corrosion_rate", "thickness_mm", "commodity", "feature_type")

_POINTS = (
    *[("points", f"{c} present", c, "present", None, "error") for c in REQUIRED_POINT_COLUMNS],
    *[("training", f"{c} present", c, "present", None, "error") for c in TRAINING],
    *[("forecast", f"{c} present", c, "present", None, "error") for c in FORECAST],
    ("points", "id_number missing", "id_number", "required", None, "error"),
    ("points", "average_corrosion_rate missing", "average_corrosion_rate", "required", None, "error"),
    ("points", "average_corrosion_rate low", "average_corrosion_rate", "min", "0", "error"),
    ("points", "average_corrosion_rate high", "average_corrosion_rate", "max", "5", "error"),
    ("points", "thickness_mm missing", "thickness_mm", "required", None, "error"),
    ("points", "thickness_mm low", "thickness_mm", "above", "0", "error"),
    ("points", "thickness_mm high", "thickness_mm", "max", "50", "error"),
    ("points", "commodity empty", "commodity", "min_length", "1", "error"),
    ("points", "feature_type unknown", "feature_type", "one_of", "|".join(FEATURE_TYPES), "warning"),
    ("points", "cml_shape unknown", "cml_shape", "one_of", "|".join(CML_SHAPES), "warning"),
    ("points", "last_inspection_date malformed", "last_inspection_date", "date", None, "warning"),
)
_OVERRIDES = (
    ("overrides", "id_number missing", "id_number", "required", None, "error"),
    ("overrides", "sme_decision invalid", "sme_decision", "one_of", "KEEP|ELIMINATE", "error"),
    ("overrides", "reason too short", "reason", "min_length", "10", "error"),
    ("overrides", "sme_name missing", "sme_name", "required", None, "error"),
    ("overrides", "original_probability low", "original_probability", "min", "0", "error"),
    ("overrides", "original_probability high", "original_probability", "max", "1", "error"),
)


def default_rules(spark: SparkSession) -> DataFrame:
    """The points, override and forecast contracts, and the three lists of required columns."""
    return spark.createDataFrame(list(_POINTS + _OVERRIDES), ", ".join(f"{c} string" for c in RULE_COLUMNS))


def _violated(df: DataFrame, column: str, op: str, bound: str | None) -> Column:
    if op == "present":
        return F.lit(column not in df.columns)
    if column not in df.columns:
        return F.lit(False)
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    gone = missing(c) if kind in ("double", "float") else c.isNull()
    if op == "required":
        return gone
    if op in ("min", "max", "above"):
        limit = dbl(float(bound))
        return ~gone & {"min": c < limit, "max": c > limit, "above": c <= limit}[op]
    if op == "one_of":
        return F.coalesce(~c.isin(*bound.split("|")), F.lit(True))
    if op == "min_length":
        return F.coalesce(F.length(c) < int(bound), F.lit(True))
    if op == "date":
        return c.isNotNull() & F.expr(f"try_cast(`{column}` as date)").isNull()
    raise ValueError(f"unknown op {op!r}")


def rules_of(rules: DataFrame, *contracts: str) -> list:
    """The rules of some contracts, by name."""
    found = rules.where(F.col("contract").isin(*contracts)).select(*RULE_COLUMNS).orderBy("contract", "rule", "column_name").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"contracts have at most {MAX_RULES} rules together")
    return found


def violations(df: DataFrame, rules: list, severity: str | None = None) -> Column:
    """An array with the names of the rules that a row violates."""
    use = [r for r in rules if severity in (None, r.severity)]
    named = [F.when(_violated(df, r.column_name, r.op, r.bound), F.lit(r.rule)) for r in use]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def contract_report(df: DataFrame, rules: DataFrame, *contracts: str, key: str = "id_number") -> DataFrame:
    """A row per rule: contract, rule, column_name, severity, n_violations, example (the least key among them).

    All rules of all ``contracts`` are evaluated in one pass; a task's partial result is two values a rule.
    An absent column violates its ``present`` rule in every row.
    """
    found = rules_of(rules, *contracts)
    if not found:
        return df.sparkSession.createDataFrame([], "contract string, rule string, column_name string, severity string, n_violations long, example string")
    flagged = df.select(F.col(key).cast("string").alias("_key") if key in df.columns else F.lit(None).cast("string").alias("_key"),
                        *[_violated(df, r.column_name, r.op, r.bound).alias(f"_v{i}") for i, r in enumerate(found)])
    one = flagged.agg(*[F.count_if(f"_v{i}").alias(f"n{i}") for i in range(len(found))],
                      *[F.min(F.when(F.col(f"_v{i}"), F.col("_key"))).alias(f"e{i}") for i in range(len(found))])
    lit = F.lit
    lines = F.array(*[
        F.struct(lit(r.contract).alias("contract"), lit(r.rule).alias("rule"), lit(r.column_name).alias("column_name"), lit(r.severity).alias("severity"),
                 F.col(f"n{i}").alias("n_violations"), F.col(f"e{i}").alias("example")) for i, r in enumerate(found)])
    return one.select(F.explode(lines).alias("r")).select("r.*")
