"""Portfolio tables kept up by signed deltas.

The latest reading per point is kept as a table in buckets of ids, and next to
it one cube: additive measures per commodity, feature type and bin.  A batch of
readings rewrites the buckets that it touches; every point whose reading changes
takes its old reading out of the cube and puts the new one in, so the cube costs
the changed points and the cells, never the portfolio.  The sums are decimals
with twelve places: what was added can be taken out exactly, in any order.

A reading wins by its ``version`` (one or more columns), not by its batch: late,
repeated and out-of-order batches give the same as one pass over all readings.
A row with ``removed`` true deletes its point; it stays in the state, so a late
older reading does not bring the point back.  Rows without an id are not points
and are left out.

A version of state and cube becomes visible by one marker, written last; a
failed batch changes nothing and a replayed one writes the same again.  Order
statistics and spreads (A3, A7-A9) are not additive: apply their operators to
:func:`points`, which needs no deduplication any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.core import band, clip, dbl, r6, step_index, zero_filled_counts
from ..operators import portfolio as PF
from ..schema import (
    CORROSION_BINS,
    CRITICAL_PCT_ALERT,
    CRITICAL_PCT_GAUGE_STEPS,
    INSPECTION_TIME_BINS,
    LIFE_GAUGE_STEPS,
    RATE_GAUGE_STEPS,
    RISK_BAND_4,
    THICKNESS_BINS,
    Analytics,
)
from .incremental import BUCKETS, _current, _folders, bucket_counts, by_bucket, commit, sized, version_numbers

KEYS = ("commodity", "feature_type", "thickness_bin", "corrosion_bin", "bin_index", "risk_band", "bucket")
READING = (PF.R_COL, PF.T_COL, "commodity", "feature_type")


def _payload(columns: Sequence[str], version: Sequence[str]) -> list[str]:
    life = [PF.L_COL] if PF.L_COL in columns else []
    return [c for c in (*READING, *life) if c not in version]


def apply_readings(batch: DataFrame, batch_id: int, target: str, version: Sequence[str], newest: bool = True,
                   buckets: int = BUCKETS, p: Analytics = Analytics()) -> None:
    """``foreachBatch`` helper: bring state and cube under ``target`` up to date with a batch of readings.

    ``version`` names the columns that order the readings of a point (the largest
    wins, the smallest if not ``newest``; equal versions are ordered by the
    reading itself).  An optional boolean ``removed`` marks deletions.  A bucket
    of points is what a batch rewrites at least; ``buckets`` must not change for
    a target.  Batch ids must grow.
    """
    spark = batch.sparkSession
    root, states = target.rstrip("/"), f"{target.rstrip('/')}/state"
    fields = [*version, "removed", *_payload(batch.columns, version)]
    if "removed" not in batch.columns:
        batch = batch.withColumn("removed", F.lit(False))
    batch = PF.normalise(batch.where(F.col("id_number").isNotNull())).withColumn("removed", F.coalesce("removed", F.lit(False)))
    fresh = batch.select("id_number", F.pmod(F.xxhash64("id_number"), F.lit(buckets)).cast("int").alias("bucket"),
                         F.struct(*fields).alias("reading"), F.lit(True).alias("fresh"))
    with sized(spark, read=_rows_to_split(fresh)):
        fresh.persist()  # used several times
        try:
            merged = _write_state(spark, fresh, batch_id, states, newest)
        finally:
            fresh.unpersist()
    here = f"{states}/v={batch_id}"
    # the delta is read off the written version: nothing of the batch is computed again
    delta = (spark.read.schema(merged).parquet(here).where("changed")
             .select(F.explode(F.array(F.struct(F.col("reading").alias("r"), F.lit(1).alias("sign")),
                                       F.struct(F.col("before").alias("r"), F.lit(-1).alias("sign")))).alias("d"))
             .select("d.r.*", "d.sign").where(~F.col("removed")))  # no reading before: all NULL, left out too
    cube = _cells(delta, p)
    if previous := _cube_paths(spark, root, below=batch_id):
        cube = spark.read.schema(cube.schema).parquet(previous[0]).unionByName(cube)
    measures = [c for c in cube.columns if c not in KEYS]
    total = cube.groupBy(*KEYS).agg(*[F.sum(c).cast(cube.schema[c].dataType).alias(c) for c in measures])
    total.where(F.col("n") != 0).write.mode("overwrite").parquet(f"{root}/cube/v={batch_id}")
    commit(spark, states, batch_id)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _cube_paths(spark, root)[2:]:
        gone = jvm.org.apache.hadoop.fs.Path(path)
        gone.getFileSystem(conf).delete(gone, True)


def _rows_to_split(rows: DataFrame) -> int:
    """The rows that there would be if each part held as many as the largest does."""
    parts = rows.groupBy(F.spark_partition_id().alias("part")).count()
    largest, n = parts.agg(F.max("count"), F.count("part")).first()
    return (largest or 0) * n


def _write_state(spark: SparkSession, fresh: DataFrame, batch_id: int, states: str, newest: bool):
    """Write the touched buckets with the batch merged in; returns the schema."""
    counts = bucket_counts(fresh)
    kept = _current(spark, states, below=batch_id)
    paths = [kept[b][0][1] for b in counts if b in kept]
    both = fresh
    if paths:
        old = spark.read.option("basePath", states).parquet(*paths)
        counts = bucket_counts(old, counts)
        both = old.select("id_number", "bucket", "reading", F.lit(False).alias("fresh")).unionByName(fresh)
    best = F.max if newest else F.min
    # combined before the shuffle, so a point with very many readings costs a row per task
    merged = both.groupBy("bucket", "id_number").agg(
        best("reading").alias("reading"), best(F.when(~F.col("fresh"), F.col("reading"))).alias("before"))
    changed = ~F.col("reading").eqNullSafe(F.col("before"))
    merged = merged.select("bucket", "id_number", "reading", changed.alias("changed"),
                           F.when(changed, F.col("before")).alias("before"))
    rows = sum(counts.values())
    with sized(spark, read=rows, shuffled=rows):
        by_bucket(merged, counts).write.mode("overwrite").partitionBy("bucket").parquet(f"{states}/v={batch_id}")
    return merged.schema


def _cube_paths(spark: SparkSession, root: str, below: int | None = None) -> list[str]:
    """Committed cubes, newest first."""
    number = lambda path: int(path.rpartition("=")[2])
    done = set(version_numbers(spark, f"{root}/state"))
    found = {number(x): x for x in _folders(spark, f"{root}/cube", "v=*")}
    return [found[v] for v in sorted(found, reverse=True) if v in done and (below is None or v < below)]


def _cells(signed: DataFrame, p: Analytics) -> DataFrame:
    """Signed readings as cells of the cube: one row per key with its additive measures."""
    st = PF.staged(signed, p, 0.0, p.life_cap)
    width = p.life_cap / p.histogram_bins
    st = st.withColumns({
        "_upper": PF.analytics_life(signed, None, p.life_cap, p),
        "_raw": R.life_analytics(F.col(PF.T_COL), F.col(PF.R_COL), p, lo=None, hi=None),
    })
    rate, t, life, sign = F.col(PF.R_COL), F.col(PF.T_COL), F.col("_life"), F.col("sign")
    keyed = st.withColumns({
        "thickness_bin": band(t, THICKNESS_BINS),
        "corrosion_bin": band(rate, CORROSION_BINS),
        "bin_index": PF.bin_index(F.col("_upper"), width, p.histogram_bins),
        "risk_band": F.col("_band4"),
        "bucket": band(F.col("_months"), INSPECTION_TIME_BINS),
    })
    total = lambda c: F.sum(c.cast("decimal(26,12)") * sign).cast("decimal(38,12)")
    known = lambda c: F.sum(F.when(c.isNotNull(), sign).otherwise(0)).cast("bigint")
    where = lambda cond: F.sum(F.when(cond, sign).otherwise(0)).cast("bigint")
    sums = {"life": life, "upper": F.col("_upper"), "rate": clip(rate), "months": F.col("_months")}
    return keyed.groupBy(*KEYS).agg(
        F.sum(sign).cast("bigint").alias("n"),
        *[F.coalesce(total(c), F.lit(0)).cast("decimal(38,12)").alias(f"sum_{n}") for n, c in sums.items()],
        *[known(c).alias(f"n_{n}") for n, c in sums.items()],
        where(life < dbl(1.0)).alias("life_below_1"), where(life < dbl(2.0)).alias("life_below_2"),
        where(life < dbl(3.0)).alias("life_below_3"), where(life < dbl(p.critical_life)).alias("critical"),
        where(F.col("_raw") < dbl(p.critical_life)).alias("raw_critical"),
        where(rate > dbl(p.dashboard_high_corrosion)).alias("high_rate"),
        where(t < dbl(p.thin_wall)).alias("thin"),
    )


def points(spark: SparkSession, target: str) -> DataFrame:
    """The current points: id, version columns and reading, one row each; raises if nothing was committed."""
    states = f"{target.rstrip('/')}/state"
    paths = [x[0][1] for x in _current(spark, states).values()]
    if not paths:
        raise FileNotFoundError(f"no committed state at {target}")
    state = spark.read.option("basePath", states).parquet(*paths)
    return state.select("id_number", "reading.*").where(~F.col("removed")).drop("removed")


def cube(spark: SparkSession, target: str) -> DataFrame:
    """The newest committed cube; raises if there is none."""
    paths = _cube_paths(spark, target.rstrip("/"))
    if not paths:
        raise FileNotFoundError(f"no committed cube at {target}")
    return spark.read.parquet(paths[0])


def start_cube_sink(stream: DataFrame, target: str, checkpoint: str, version: Sequence[str], newest: bool = True,
                    buckets: int = BUCKETS, p: Analytics = Analytics(), trigger_once: bool = False):
    """Keep state and cube under ``target`` up to date from a stream of readings."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: apply_readings(batch, batch_id, target, version, newest, buckets, p))
    return (w.trigger(availableNow=True) if trigger_once else w).start()


# ---- the tables, read off a cube; columns and values as in ``operators.portfolio``


def _n(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint")


def _mean(name: str) -> Column:
    return F.try_divide(F.sum(f"sum_{name}").cast("double"), F.sum(f"n_{name}").cast("double"))


def _filled(cells: DataFrame, dim: DataFrame, keys, attrs, sums=()) -> DataFrame:
    found = zero_filled_counts(cells.withColumn("n", F.col("n").cast("double")), dim, keys, attrs, sums=("n", *sums))
    return found.withColumn("n_points", F.coalesce("sum_n", F.lit(0)).cast("bigint"))


def risk_matrix(cells: DataFrame) -> DataFrame:
    """A1."""
    return _filled(cells, PF.risk_matrix_dim(cells.sparkSession), ["thickness_bin", "corrosion_bin"],
                   ["thickness_order", "corrosion_order"]).select(
        "thickness_order", "thickness_bin", "corrosion_order", "corrosion_bin", "n_points")


def life_histogram(cells: DataFrame, p: Analytics = Analytics()) -> DataFrame:
    """A2."""
    bins = _filled(cells.withColumn("upper", F.col("sum_upper").cast("double")), PF.histogram_dim(cells.sparkSession, p),
                   ["bin_index"], ["bin_lo", "bin_hi"], ("upper",))
    everything = Window.partitionBy()  # over the 21 bin rows only
    mean = F.try_divide(F.sum("sum_upper").over(everything), F.sum("n_points").over(everything).cast("double"))
    return bins.select("bin_index", "bin_lo", "bin_hi", "n_points", r6(mean).alias("mean_life"))


def feature_commodity_hierarchy(cells: DataFrame) -> DataFrame:
    """A5."""
    return (cells.rollup("feature_type", "commodity").agg(_n("n").alias("n_points"), F.grouping_id().alias("level"))
            .where(F.col("level") < 3)
            .select("feature_type", "commodity", F.col("level").cast("int").alias("level"), "n_points"))


def portfolio_health(cells: DataFrame) -> DataFrame:
    """A6."""
    one = cells.agg(_mean("life").alias("avg_life"), _mean("rate").alias("avg_rate"),
                    F.try_divide(F.sum("critical") * dbl(100.0), F.sum("n")).alias("critical_pct"))
    return one.select(
        r6(F.col("avg_life")).alias("avg_remaining_life_years"),
        r6(F.col("critical_pct")).alias("critical_pct"),
        r6(F.col("avg_rate")).alias("avg_corrosion_rate"),
        step_index(F.col("avg_life"), LIFE_GAUGE_STEPS).alias("life_band"),
        step_index(F.col("critical_pct"), CRITICAL_PCT_GAUGE_STEPS).alias("critical_band"),
        step_index(F.col("avg_rate"), RATE_GAUGE_STEPS).alias("rate_band"),
        (F.col("critical_pct") > dbl(CRITICAL_PCT_ALERT)).alias("critical_alert"),
    )


def risk_distribution(cells: DataFrame) -> DataFrame:
    """A10."""
    return cells.agg(*[F.coalesce(F.sum(F.when(F.col("risk_band") == label, F.col("n"))), F.lit(0)).cast("bigint")
                       .alias(label.lower()) for _lo, _hi, label in RISK_BAND_4])


def inspection_scheduling(cells: DataFrame) -> DataFrame:
    """A11."""
    return cells.agg(_n("life_below_1").alias("immediate_attention"), _n("life_below_2").alias("next_6_months"),
                     _n("life_below_3").alias("next_12_months"), r6(_mean("months")).alias("avg_interval_months"))


def commodity_risk(cells: DataFrame) -> DataFrame:
    """A12."""
    return (cells.where(F.col("commodity").isNotNull()).groupBy("commodity")
            .agg(_n("n").alias("n_points"), r6(_mean("rate")).alias("avg_corrosion"), _n("raw_critical").alias("critical_count")))


def inspection_timeline(cells: DataFrame) -> DataFrame:
    """A13."""
    dim = PF.bin_dim(cells.sparkSession, INSPECTION_TIME_BINS, "bucket")
    return _filled(cells, dim, ["bucket"], ["bucket_order"]).select("bucket_order", "bucket", "n_points")


def report_metrics(cells: DataFrame) -> DataFrame:
    """A14."""
    return cells.agg(_n("n").alias("total_assets"), r6(_mean("life")).alias("avg_remaining_life_years"),
                     _n("high_rate").alias("high_corrosion_cmls"), _n("thin").alias("thin_wall_cmls"))
