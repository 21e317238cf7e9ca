"""Plan shape checks and the oracle comparison on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from oracle import ORACLE_SQL
from pitwall.plans import registry
from pitwall.plans.registry import QUERIES
from tools.compare import TABLES, _rows

SF = "/root/testdata/sf0.001"
ML = {n for n in QUERIES if n.startswith("model_") and n != "model_metrics"} | {
    "cross_validated_f1", "basic_forest", "basic_forest_trees", "grid_search"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "risk_level" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ML))
def test_plan_has_no_python_or_cartesian(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "RoundRobin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_dedup_reduces_before_shuffle(spark):
    from pitwall.sources.mapping import load_points

    df = load_points(spark, SF)
    df.write.format("noop").mode("overwrite").save()
    text = df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scan_prunes_columns(spark):
    import re

    from pitwall.plans.registry import QUERIES

    plan = _plan(QUERIES["commodity_distribution"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<l_partkey:bigint>"]


def test_partition_count_invariance(spark):
    q = E.queries()["forecast_summary"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = [tuple(r) for r in q(spark, SF).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = [tuple(r) for r in q(spark, SF).collect()]
    assert a == b


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_match_smoke(spark, duck, name):
    sdf = E.queries()[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    assert sorted(sdf.columns) == sorted(dcols)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    flat = {c for c, t in spark_types.items() if t}
    assert {c: t for c, t in spark_types.items() if c in flat} == {c: t for c, t in zip(dcols, dtypes) if c in flat}
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(dcols, rel.fetchall())


def test_override_state_partition_invariance(spark):
    q = E.queries()["current_overrides"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(tuple(r) for r in q(spark, SF).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(tuple(r) for r in q(spark, SF).collect())
    assert a == b


def test_pass_counts(spark):
    """Scans and shuffles of the reports that used to repeat them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda n: _plan(QUERIES[n](spark, SF))
        assert plan("classification_report").count("Scan parquet") == 2  # points and override log
        applied = plan("apply_overrides")
        # deduplicated points and override state are partitioned by id, and joined without a new shuffle
        assert applied.count("Exchange hashpartitioning") == 2
        assert plan("validation_report").count("Scan parquet") == 3  # counts, examples, distributions
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_kept_fit_goes_with_its_input_files_and_when_told(spark, tmp_path):
    made = []
    fit = lambda: registry._once("test", spark, str(tmp_path), lambda: made.append(1) or len(made))
    spark.range(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert (fit(), fit()) == (1, 1)
    spark.range(7).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert (fit(), fit()) == (2, 2)
    kept = dict(registry._TRAINED)
    try:
        registry.forget_fits()
        assert fit() == 3
    finally:
        registry._TRAINED.update({k: v for k, v in kept.items() if k[0] != "test"})
