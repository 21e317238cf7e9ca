"""A single id holding a third of all rows: results stay whole and exact."""

import datetime as dt

from pyspark.sql import functions as F

from pitwall.operators import overrides as O
from pitwall.sources import mapping as MP


def _lineitem(spark, n=3000, hot_share=3):
    rows = []
    for i in range(n):
        hot = i % hot_share == 0
        rows.append((1 if hot else 10 + i, 1 if hot else i % 7 + 1, 1000 + (i * 37) % 500, 10 + i % 90,
                     float(1 + i % 50), 1000.0 + i, (i % 11) / 100.0, (i % 9) / 100.0, "R" if i % 2 else "N",
                     "F" if i % 3 else "O", dt.datetime(1995, 1, 1) + dt.timedelta(days=i % 2000)))
    schema = ("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
              "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
              "l_shipdate timestamp_ntz")
    return spark.createDataFrame(rows, schema).repartition(6)


def test_hot_id_dedup_exact(spark):
    li = _lineitem(spark)
    raw = MP.raw_points(li)
    pts = MP.dedup_points(raw)
    hot = raw.where(F.col("id_number") == "PT-1-1")
    assert hot.count() == 1000
    expected = hot.orderBy(*MP.DEDUP_ORDER).first()
    got = pts.where(F.col("id_number") == "PT-1-1").collect()
    assert len(got) == 1 and got[0].l_partkey == expected.l_partkey
    assert got[0].l_extendedprice == expected.l_extendedprice
    assert pts.count() == raw.select("id_number").distinct().count()
    pts.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in pts._jdf.queryExecution().toString()


def test_readings_are_derived_after_the_dedup(spark, scratch):
    nulls = [F.when(F.col("l_linenumber") != 3, F.col(c)).alias(c) if c in ("l_orderkey", "l_partkey", "l_tax") else c for c in MP.LINEITEM_COLUMNS]
    _lineitem(spark).select(*nulls).write.parquet(f"{scratch}/lineitem.parquet")
    got, want = MP.load_points(spark, scratch), MP.dedup_points(MP.load_raw(spark, scratch))
    assert got.dtypes == want.dtypes and got.count() == want.count() > 1000
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS commodity") < plan.index("Window")  # above the window, so not in its shuffle
    state = O.current_overrides(MP.override_log(MP.load_raw(spark, scratch)))
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # the ids are dealt out once for the dedup and the join
        joined = got.join(state, "id_number")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert joined.count("Exchange hashpartitioning") == 2


def test_hot_id_override_state(spark):
    log = MP.override_log(MP.raw_points(_lineitem(spark)))
    state = O.current_overrides(log)
    hot = log.where(F.col("id_number") == "PT-1-1")
    top = hot.orderBy(F.col("override_date").desc(), "sme_name", "sme_decision", "reason").first()
    got = state.where(F.col("id_number") == "PT-1-1").first()
    assert (got.override_date, got.sme_name, got.sme_decision) == (top.override_date, top.sme_name, top.sme_decision)
    assert state.count() == log.select("id_number").distinct().count()
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan  # reduced on the map side before the shuffle


def test_bucketed_tables_join_without_shuffle(spark, scratch):
    from pitwall.operators import decide as D

    spark.sql(f"CREATE DATABASE IF NOT EXISTS pw_test LOCATION '{scratch}/warehouse'")
    raw = MP.raw_points(_lineitem(spark))
    MP.save_bucketed(MP.dedup_points(raw), "pw_test.points", 4)
    MP.save_bucketed(O.current_overrides(MP.override_log(raw)), "pw_test.override_state", 4)
    pts, state = spark.table("pw_test.points"), spark.table("pw_test.override_state")
    joined = O.apply_overrides(D.decide_basic(pts), state)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge path
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == pts.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
