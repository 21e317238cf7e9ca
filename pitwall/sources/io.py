"""Sources and sinks.

Reads use explicit schemas (no inference: malformed dates such as
``2028-00-08`` stay strings and are parsed with ``try_to_date`` where used).
Writes go to shared storage paths given by the caller; nothing is collected
to the driver except the documented emptiness guards and the 5-row preview.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import normalise
from ..schema import OVERRIDE_SCHEMA, POINT_SCHEMA

_OVERRIDE_JSON_SCHEMA = T.StructType(
    [T.StructField(f.name, T.StringType() if f.name == "override_date" else f.dataType) for f in OVERRIDE_SCHEMA]
)


CORRUPT = "_corrupt_record"


def read_points_csv(spark: SparkSession, path: str, schema: T.StructType = POINT_SCHEMA) -> DataFrame:
    """Point table from CSV with a header, read with a fixed schema.

    Columns are matched by name against the header, so a file with fewer
    columns (the minimal six) is read too; absent columns come back NULL
    and are dropped so V2 can report them.  A row with a cell that does not
    parse keeps its text in ``_corrupt_record`` (NULL for good rows) besides the
    cells that do; the text ``NaN`` is a missing measurement, so NULL.
    """
    header = spark.read.option("header", True).csv(path).columns
    wanted = T.StructType([f for f in schema.fields if f.name in header])
    extra = [T.StructField(c, T.StringType()) for c in header if c not in wanted.fieldNames()]
    full = T.StructType([*wanted.fields, *extra])
    full = T.StructType([full[c] for c in header] + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(full).option("header", True).option("enforceSchema", True)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return normalise(df)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """S1 dispatch: parquet directories / files, else CSV."""
    if path.rstrip("/").endswith(".parquet"):
        return normalise(spark.read.parquet(path))
    return read_points_csv(spark, path)


def read_overrides_json(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Override list from a JSON array file; a missing file is an empty log.

    ``strict=True`` raises on a corrupt file, ``strict=False`` treats it as
    empty -- the two behaviours the original had in two places.
    """
    try:
        schema = T.StructType([*_OVERRIDE_JSON_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
        raw = (spark.read.schema(schema)
               .option("multiLine", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], OVERRIDE_SCHEMA)
        raise
    raw.persist()  # the corrupt column alone can't be queried from the file
    try:
        bad = not raw.where(F.col("_corrupt_record").isNotNull()).isEmpty()
    finally:
        raw.unpersist()
    if bad:
        if strict:
            raise ValueError(f"Invalid JSON in override file {path}")
        return spark.createDataFrame([], OVERRIDE_SCHEMA)
    return raw.select(
        *[F.to_timestamp_ntz(F.col(c)).alias(c) if c == "override_date" else F.col(c) for c in OVERRIDE_SCHEMA.names]
    )


def write_predictions_csv(df: DataFrame, path: str) -> str:
    """S3: CSV with header; an empty frame is refused (guard action)."""
    if df.isEmpty():
        raise ValueError("Cannot save empty predictions DataFrame")
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report_json(sections: dict[str, DataFrame], path: str) -> str:
    """Each report section as JSON lines under ``path/<section>``."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")
    return path


def report_as_json_column(df: DataFrame) -> DataFrame:
    """S4 (single record): one JSON string per row of a (one-row) report."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def dataset_preview(df: DataFrame, n: int = 5, order_by: str = "id_number") -> DataFrame:
    """First n rows by id, each carrying the table's row count.

    A deterministic order replaces the original's file order; the column
    list is ``df.columns`` on the driver.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(order_by).limit(n).withColumn("total_rows", total)


def export_full_dataset(df: DataFrame, path: str) -> str:
    """Plain CSV export of the input table."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path
