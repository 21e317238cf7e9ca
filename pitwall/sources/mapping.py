"""Canonical mapping from the driver's ``lineitem`` table to inspection points.

The driver tables hold no inspection points, so one fixed, documented mapping
turns each ``lineitem`` row into a point reading (``raw``), keeps one reading
per id (``points``) and derives an expert-override log (``override_log``).
All three are lazy DataFrames: their work grows with ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import dbl
from ..schema import CML_SHAPES, COMMODITIES, FEATURE_TYPES

# Columns read from lineitem (everything else is pruned at the scan).
LINEITEM_COLUMNS = (
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key, values):
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def with_ids(lineitem: DataFrame) -> DataFrame:
    """The lineitem columns of a reading, and its point's id."""
    return lineitem.select(
        F.concat(
            F.lit("PT-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
        ).alias("id_number"),
        *LINEITEM_COLUMNS,
    )


def raw_points(lineitem: DataFrame) -> DataFrame:
    """One point reading per lineitem row; ids repeat (input for V3)."""
    return readings(with_ids(lineitem))


def readings(li: DataFrame) -> DataFrame:
    """Rows of :func:`with_ids` as point readings."""
    rate = (
        (F.lit(3) * F.round(F.col("l_discount") * 100).cast("int") + F.round(F.col("l_tax") * 100).cast("int"))
        .cast("double")
        / dbl(100.0)
    )
    thickness = (F.lit(20) + F.lit(2) * F.col("l_quantity").cast("int")).cast("double") / dbl(10.0)
    prob = (F.round(F.col("l_extendedprice") * 100).cast("bigint") % 1000).cast("double") / dbl(1000.0)
    return li.select(
        "id_number",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_shipdate",
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None).cast("double")).otherwise(rate).alias("average_corrosion_rate"),
        F.when(F.col("l_suppkey") % 89 == 0, F.lit(None).cast("double")).otherwise(thickness).alias("thickness_mm"),
        _pick((F.col("l_partkey") % 9).cast("int"), COMMODITIES).alias("commodity"),
        _pick((F.col("l_suppkey") % 9).cast("int"), FEATURE_TYPES).alias("feature_type"),
        _pick((F.col("l_orderkey") % 3).cast("int"), CML_SHAPES).alias("cml_shape"),
        F.when(F.col("l_partkey") % 53 == 0, F.lit(None).cast("date"))
        .otherwise(F.col("l_shipdate").cast("date"))
        .alias("last_inspection_date"),
        prob.alias("elimination_probability"),
        "l_returnflag",
        "l_linestatus",
        # tie-breakers for a deterministic choice among equal readings
        "l_quantity",
        "l_discount",
        "l_tax",
    )


POINT_COLUMNS = (
    "id_number",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_shipdate",
    "average_corrosion_rate",
    "thickness_mm",
    "commodity",
    "feature_type",
    "cml_shape",
    "last_inspection_date",
    "elimination_probability",
    "l_returnflag",
    "l_linestatus",
)


DEDUP_ORDER = ("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus")


def dedup_points(raw: DataFrame) -> DataFrame:
    """Keep the first reading per id by (partkey, suppkey, price, shipdate, ...).

    ``row_number() = 1`` per id.  Spark plans this as a partial per-partition
    group limit *before* the shuffle, so an id holding a large share of all rows
    is cut to one row per map task -- a map-side combine -- and columns a query
    does not use are pruned from the scan and the shuffle.  The result is
    partitioned by id, so a join with the override state needs no new shuffle.
    """
    return _first_by_id(raw).select(*POINT_COLUMNS)


def _first_by_id(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("id_number").orderBy(*[F.col(c).asc_nulls_first() for c in DEDUP_ORDER])
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def override_log(raw: DataFrame) -> DataFrame:
    """Expert override log derived from returned lineitems (several per id)."""
    return raw.where(F.col("l_returnflag") == "R").select(
        "id_number",
        F.when(F.col("l_linestatus") == "F", F.lit("KEEP")).otherwise(F.lit("ELIMINATE")).alias("sme_decision"),
        F.concat(F.lit("reason "), F.col("l_returnflag"), F.col("l_linestatus")).alias("reason"),
        F.concat(F.lit("sme-"), (F.col("l_suppkey") % 7).cast("string")).alias("sme_name"),
        F.col("l_shipdate").alias("override_date"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("elimination_probability") > dbl(0.5), F.lit("ELIMINATE"))
        .otherwise(F.lit("KEEP"))
        .alias("original_prediction"),
        F.lit(None).cast("double").alias("original_probability"),
    )


def nan_points(points: DataFrame) -> DataFrame:
    """``points`` with NaN (not NULL) measurements in some rows, as text files and pandas give them."""
    nan = F.lit(float("nan"))
    return points.withColumns({
        "average_corrosion_rate": F.when(F.col("l_partkey") % 7 == 0, nan).otherwise(F.col("average_corrosion_rate")),
        "thickness_mm": F.when(F.col("l_suppkey") % 11 == 0, nan).otherwise(F.col("thickness_mm")),
    })


def own_forecast_points(points: DataFrame) -> DataFrame:
    """``points`` that bring columns named like the forecast's; dates are text, some malformed."""
    life = (F.col("l_partkey") % 400).cast("double") / dbl(10.0)
    due = F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_suppkey") % 3000).cast("int")).cast("string")
    return points.withColumns({
        "remaining_life_years": F.when(F.col("l_partkey") % 31 != 0, life),
        "next_inspection_date": F.when(F.col("l_partkey") % 13 == 0, F.lit("2028-00-08")).otherwise(due),
        "risk_level": F.when(life < 5, F.lit("HIGH")).otherwise(F.lit("LOW")),
        "recommended_inspection_frequency_months": (F.col("l_suppkey") % 72).cast("int"),
    })


def varied_override_log(raw: DataFrame) -> DataFrame:
    """The override log with entries that break each rule of the contract, and many that pass."""
    return raw.where(F.col("l_returnflag") == "R").select(
        F.when(F.col("l_orderkey") % 37 != 0, F.col("id_number")).alias("id_number"),
        F.when(F.col("l_orderkey") % 41 == 0, F.lit("MAYBE")).when(F.col("l_orderkey") % 43 == 0, F.lit(None).cast("string"))
        .when(F.col("l_linestatus") == "F", F.lit("KEEP")).otherwise(F.lit("ELIMINATE")).alias("sme_decision"),
        F.concat(F.lit("reason"), F.repeat(F.lit("!"), (F.col("l_partkey") % 9).cast("int"))).alias("reason"),
        F.when(F.col("l_suppkey") % 17 != 0, F.concat(F.lit("sme-"), (F.col("l_suppkey") % 7).cast("string"))).alias("sme_name"),
        F.col("l_shipdate").alias("override_date"),
        F.when(F.col("l_partkey") % 5 != 0, (F.col("l_orderkey") % 130 - 10).cast("double") / dbl(100.0)).alias("original_probability"),
    )


def load_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_points(read_table(spark, sf_dir, "lineitem"))


def load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dedup_points`` of all readings, which are derived after the dedup: its shuffle holds lineitem columns only."""
    rows = _first_by_id(with_ids(read_table(spark, sf_dir, "lineitem")))
    return readings(rows).select(*POINT_COLUMNS)


def load_override_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return override_log(load_raw(spark, sf_dir))


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "id_number") -> None:
    """Materialize a derived table once, bucketed and sorted by ``key``.

    Two tables bucketed on the same key with the same bucket count join
    without a shuffle (e.g. points and the current override state), so the
    reports read the materialized tables instead of recomputing the dedup.
    The table lives in the session's warehouse (shared storage on a cluster).
    Both inputs here are unique per id, so buckets stay balanced.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
