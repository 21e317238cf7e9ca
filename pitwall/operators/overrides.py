"""Expert overrides as an append-only log.

The original kept a JSON list rewritten in place (read-modify-write with no
lock).  Here every override is a row appended to a log table; the current
state is the latest entry per id, computed by a partially aggregated
``min(struct(...))`` so a hot id is reduced map-side instead of being
collected into one window task.  Nothing passes through the driver.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import count_if, dbl, py_round
from ..schema import DECISIONS, OVERRIDE_SCHEMA, REMOVED

OVERRIDE_COLUMNS = [f.name for f in OVERRIDE_SCHEMA.fields]


def _wall_micros(date):
    """Microseconds of the date as written (no time zone): day number and time of day."""
    at = date.cast("timestamp_ntz")
    day = F.unix_date(at.cast("date")).cast("bigint") * 86_400_000_000
    seconds = F.hour(at).cast("bigint") * 3600 + F.minute(at) * 60
    return day + seconds * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")


def current_overrides(log: DataFrame) -> DataFrame:
    """Latest entry per id.

    Order: override_date desc (NULL last), then sme_name, sme_decision,
    reason, original_prediction (NULL last) -- a total order, so the result
    does not depend on partitioning.  Dates are compared as they were written,
    whatever the session's time zone.  An id whose latest entry is a removal
    (:func:`removals`) has no current override.
    """
    date_key = F.when(F.col("override_date").isNull(), F.lit(2**62)).otherwise(-_wall_micros(F.col("override_date")))
    key = F.struct(
        date_key.alias("k0"),
        F.col("sme_name").alias("k1"),
        F.col("sme_decision").alias("k2"),
        F.col("reason").alias("k3"),
        F.col("original_prediction").isNull().alias("k4"),
        F.col("original_prediction").alias("k5"),
        F.col("override_date").alias("v_date"),
        F.col("original_probability").alias("v_prob"),
    )
    best = log.groupBy("id_number").agg(F.min(key).alias("b")).where(~F.col("b.k2").eqNullSafe(REMOVED))
    return best.select(
        "id_number",
        F.col("b.k2").alias("sme_decision"),
        F.col("b.k3").alias("reason"),
        F.col("b.k1").alias("sme_name"),
        F.col("b.v_date").alias("override_date"),
        F.col("b.k5").alias("original_prediction"),
        F.col("b.v_prob").alias("original_probability"),
    )


def new_override(spark, id_number: str, sme_decision: str, reason: str, sme_name: str,
                 original_prediction: str | None = None, original_probability: float | None = None,
                 override_date: _dt.datetime | None = None) -> DataFrame:
    """One override row; the decision must be KEEP or ELIMINATE (as the original enforced)."""
    if sme_decision not in DECISIONS:
        raise ValueError("sme_decision must be 'KEEP' or 'ELIMINATE'")
    when = override_date or _dt.datetime.now()
    return spark.createDataFrame(
        [(id_number, sme_decision, reason, sme_name, when, original_prediction, original_probability)],
        OVERRIDE_SCHEMA)


def upsert_overrides(log: DataFrame, entries: DataFrame) -> DataFrame:
    """O1 (logical): the log with new entries appended; use :func:`current_overrides` for state."""
    return log.unionByName(entries.select(*OVERRIDE_COLUMNS))


def append_override_log(entries: DataFrame, path: str) -> None:
    """O2: append entries to the shared log table (no read-modify-write)."""
    entries.select(*OVERRIDE_COLUMNS).write.mode("append").parquet(path)


def read_override_log(spark, path: str) -> DataFrame:
    """The log at ``path``; an absent log is an empty table."""
    try:
        return spark.read.schema(OVERRIDE_SCHEMA).parquet(path)
    except Exception as e:  # noqa: BLE001 - a missing path means no overrides yet
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], OVERRIDE_SCHEMA)
        raise


def get_overrides(state: DataFrame, ids: DataFrame) -> DataFrame:
    """O3: current overrides for a set of ids (semi join: repeated ids need no distinct)."""
    return state.join(ids.select("id_number"), "id_number", "left_semi")


def remove_overrides(state: DataFrame, ids: DataFrame) -> DataFrame:
    """O5 (logical): current state without the given ids (anti join)."""
    return state.join(ids.select("id_number"), "id_number", "left_anti")


def removals(ids: DataFrame, when: _dt.datetime, sme_name: str | None = None) -> DataFrame:
    """One removal row per id, to be appended to the log like any entry.

    :func:`current_overrides` drops an id whose latest row is a removal, so the
    removal survives a re-read of the log; a later override brings the id back.
    """
    return ids.select("id_number").distinct().select(
        "id_number", F.lit(REMOVED).alias("sme_decision"), F.lit(None).cast("string").alias("reason"),
        F.lit(sme_name).cast("string").alias("sme_name"), F.lit(when).cast("timestamp_ntz").alias("override_date"),
        F.lit(None).cast("string").alias("original_prediction"), F.lit(None).cast("double").alias("original_probability"))


def apply_overrides(scored: DataFrame, state: DataFrame, decision_col: str = "recommendation") -> DataFrame:
    """Left join of the scored rows with the current overrides on id.

    The override state grows with the data, so no broadcast hint is given:
    adaptive execution broadcasts it only when its measured size is below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and sort-merges
    otherwise; skewed ids on the scored side are split by AQE skew join.
    ``final_decision`` is the expert decision where one exists, else the
    model's; ``overridden_decision`` holds the raw expert value.
    """
    s = state.select(
        "id_number",
        F.col("sme_decision").alias("_sme_decision"),
        F.col("reason").alias("sme_reason"),
        F.col("sme_name").alias("_sme_name"),
        F.col("override_date").alias("sme_override_date"),
    )
    j = scored.join(s, "id_number", "left")
    has = F.col("_sme_decision").isNotNull()
    return j.withColumns({
        "has_sme_override": has,
        "sme_decision": F.col("_sme_decision"),
        "sme_name": F.col("_sme_name"),
        "overridden_decision": F.col("_sme_decision"),
        "final_decision": F.coalesce(F.col("_sme_decision"), F.col(decision_col)),
    }).drop("_sme_decision", "_sme_name")


def override_statistics(state: DataFrame) -> DataFrame:
    """Totals by decision, ML disagreements, agreement % (1 decimal).

    A missing original prediction counts as a disagreement, as in the
    original.  An empty state gives zeros and a NULL agreement rate.
    """
    dis = count_if(~F.col("sme_decision").eqNullSafe(F.col("original_prediction")))
    agg = state.agg(
        F.count(F.lit(1)).alias("total_overrides"),
        count_if(F.col("sme_decision") == "KEEP").alias("keep_overrides"),
        count_if(F.col("sme_decision") == "ELIMINATE").alias("eliminate_overrides"),
        dis.alias("disagreements_with_ml"),
    )
    n = F.col("total_overrides")
    pct = (n - F.col("disagreements_with_ml")) * dbl(100.0) / n
    return agg.withColumn("_pct", F.when(n > 0, pct)).select(
        "total_overrides", "keep_overrides", "eliminate_overrides", "disagreements_with_ml",
        py_round("_pct", 1).alias("agreement_rate"))


def recent_overrides(state: DataFrame, n: int = 10) -> DataFrame:
    """The n latest overrides (ties by id)."""
    return (
        state.orderBy(F.col("override_date").desc_nulls_last(), F.col("id_number").asc())
        .limit(n)
        .select("id_number", "sme_decision", "sme_name", "override_date")
    )


def overrides_by_sme(state: DataFrame) -> DataFrame:
    """Overrides per expert."""
    return state.groupBy("sme_name").agg(F.count(F.lit(1)).alias("n_overrides"))
