"""Cubes kept up by signed deltas equal the full recomputation."""

import contextlib
import glob
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwall.operators import portfolio as PF
from pitwall.streaming import cubes as C
from pitwall.streaming import incremental as S

SCHEMA = ("id_number string, seq int, removed boolean, average_corrosion_rate double, thickness_mm double, "
          "commodity string, feature_type string")
TABLES = ["risk_matrix", "life_histogram", "feature_commodity_hierarchy", "portfolio_health", "risk_distribution",
          "inspection_scheduling", "commodity_risk", "inspection_timeline", "report_metrics"]


def _reading(rng):
    def pick(values):
        return None if rng.random() < 0.1 else rng.choice(values)

    rate = float("nan") if rng.random() < 0.05 else pick([0.0, 0.003, 0.07, 0.12, 0.21, 0.4])
    return (None if rng.random() < 0.02 else f"id-{rng.randrange(40)}", rng.randrange(60), rng.random() < 0.15, rate,
            pick([0.5, 2.9, 3.0, 4.4, 6.1, 9.7, 30.0]), pick(["Gas", "Steam"]), pick(["Pipe", "Tee"]))


def _full(df, newest):
    """The winner per id over all readings, without the deleted ones."""
    whole = F.struct("seq", "removed", *C.READING)
    w = Window.partitionBy("id_number").orderBy(whole.desc() if newest else whole.asc())
    return (PF.normalise(df).where("id_number is not null").withColumn("rn", F.row_number().over(w))
            .where("rn = 1 and not removed").drop("rn", "removed"))


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("newest", [True, False])
def test_random_batches_equal_the_full_recomputation(spark, scratch, newest):
    rng, target, seen = random.Random(5 + newest), f"{scratch}/cube", []
    for batch_id in range(4):
        rows = [_reading(rng) for _ in range(35)]
        batch = spark.createDataFrame(rows, SCHEMA)
        C.apply_readings(batch, batch_id, target, ["seq"], newest, buckets=4)
        seen += rows
        if batch_id == 2:  # replayed
            C.apply_readings(batch, batch_id, target, ["seq"], newest, buckets=4)
        if batch_id == 3:
            C.apply_readings(batch, 9, target, ["seq"], newest, buckets=4)  # the same readings under a later id
            want, cells = _full(spark.createDataFrame(seen, SCHEMA), newest).cache(), C.cube(spark, target)
            got = C.points(spark, target)
            assert _rows(got.select(sorted(got.columns))) == _rows(want.select(sorted(want.columns)))
            for name in TABLES:
                a, b = getattr(C, name)(cells), getattr(PF, name)(want)
                assert a.dtypes == b.dtypes and _rows(a) == _rows(b), name


def test_everything_removed_leaves_an_empty_cube(spark, scratch):
    target = f"{scratch}/cube"
    row = ("a", 1, False, 0.1, 5.0, "Gas", "Pipe")
    C.apply_readings(spark.createDataFrame([row], SCHEMA), 0, target, ["seq"])
    assert C.report_metrics(C.cube(spark, target)).first().total_assets == 1
    C.apply_readings(spark.createDataFrame([("a", 2, True, None, None, None, None)], SCHEMA), 1, target, ["seq"])
    C.apply_readings(spark.createDataFrame([row], SCHEMA), 2, target, ["seq"])  # late: the point stays deleted
    C.apply_readings(spark.createDataFrame([], SCHEMA), 3, target, ["seq"])  # an empty batch
    assert C.cube(spark, target).isEmpty() and C.points(spark, target).isEmpty()
    assert C.report_metrics(C.cube(spark, target)).first().total_assets == 0
    assert len(C.risk_matrix(C.cube(spark, target)).collect()) == 25


def test_a_batch_that_fails_before_its_marker_changes_nothing(spark, scratch, monkeypatch):
    target = f"{scratch}/cube"
    one = spark.createDataFrame([("a", 1, False, 0.1, 5.0, "Gas", "Pipe")], SCHEMA)
    two = spark.createDataFrame([("a", 2, False, 0.3, 9.0, "Gas", "Pipe"), ("b", 1, False, 0.1, 5.0, "Gas", "Pipe")], SCHEMA)
    C.apply_readings(one, 0, target, ["seq"])

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(C, "commit", crash)
        with pytest.raises(RuntimeError):
            C.apply_readings(two, 1, target, ["seq"])
    assert C.report_metrics(C.cube(spark, target)).first().total_assets == 1
    assert C.points(spark, target).first().seq == 1
    C.apply_readings(two, 1, target, ["seq"])
    assert C.report_metrics(C.cube(spark, target)).first().total_assets == 2


def test_a_large_bucket_is_written_by_many_tasks(spark, scratch):
    ids = spark.range(40_000).selectExpr("concat('id-', id) id_number", "1 seq", "false removed", "id / 1e5 average_corrosion_rate",
                                         "3.0 + id % 70 thickness_mm", "'Gas' commodity", "'Pipe' feature_type").repartition(8)
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        C.apply_readings(ids, 0, f"{scratch}/cube", ["seq"], buckets=1)
        S.apply_state_batch(ids.select("id_number", "seq"), 0, f"{scratch}/state", buckets=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")  # as in the session's settings
    assert C.points(spark, f"{scratch}/cube").count() == 40_000 and C.report_metrics(C.cube(spark, f"{scratch}/cube")).first().total_assets == 40_000
    assert S.latest_state(spark, f"{scratch}/state").count() == 40_000
    for files in ("cube/state", "state"):
        assert len(glob.glob(f"{scratch}/{files}/v=0/bucket=0/*.parquet")) > 3


@contextlib.contextmanager
def _conf(spark, **settings):
    """Session settings (dots as ``__``) inside the block."""
    settings = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
        assert {k: spark.conf.get(k) for k in settings} == settings  # nothing is left changed
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _many(spark, n, seq=1):
    return spark.range(n).selectExpr("concat('id-', id) id_number", f"{seq} seq", "false removed", "id / 1e5 average_corrosion_rate",
                                     "3.0 + id % 70 thickness_mm", "'Gas' commodity", "'Pipe' feature_type")


def _largest(rows):
    return rows.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_a_large_bucket_is_shared_out_without_adaptive_execution(spark, scratch, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 4_000, raising=False)
    ids = _many(spark, 40_000)
    with _conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="2"):
        C.apply_readings(ids, 0, f"{scratch}/cube", ["seq"], buckets=2)
        S.apply_state_batch(ids.select("id_number", "seq"), 0, f"{scratch}/state", buckets=2)
        S.apply_state_batch(_many(spark, 30_000, 2).select("id_number", "seq"), 1, f"{scratch}/state", buckets=2)
    for files, v, state in (("cube/state", 0, C.points(spark, f"{scratch}/cube")), ("state", 1, S.latest_state(spark, f"{scratch}/state"))):
        assert state.count() == state.select("id_number").distinct().count() == 40_000
        for b in range(2):
            parts = glob.glob(f"{scratch}/{files}/v={v}/bucket={b}/*.parquet")
            assert len(parts) >= 5 and max(spark.read.parquet(x).count() for x in parts) <= 6_000
    assert C.report_metrics(C.cube(spark, f"{scratch}/cube")).first().total_assets == 40_000
    assert S.latest_state(spark, f"{scratch}/state").where("seq = 2").count() == 30_000


def test_tasks_hold_few_rows_whatever_the_sessions_numbers_of_parts(spark, scratch, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 4_000, raising=False)
    _many(spark, 40_000).repartition(20).write.parquet(f"{scratch}/one")
    _many(spark, 30_000, 2).repartition(20).write.parquet(f"{scratch}/two")
    merged, write = [], C.by_bucket

    def seen(rows, *args):
        merged.append(_largest(rows))
        return write(rows, *args)

    read, state = [], C._write_state
    monkeypatch.setattr(C, "by_bucket", seen)
    monkeypatch.setattr(C, "_write_state", lambda spark, fresh, *args: read.append(_largest(fresh)) or state(spark, fresh, *args))
    with _conf(spark, spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions="2", spark__sql__files__minPartitionNum="1",
               spark__sql__files__openCostInBytes="1"):
        for i, name in enumerate(("one", "two")):
            C.apply_readings(spark.read.parquet(f"{scratch}/{name}"), i, f"{scratch}/cube", ["seq"], buckets=2)
    assert max(read) <= 8_000 and max(merged) <= 6_000
    points = C.points(spark, f"{scratch}/cube")
    assert sorted(map(tuple, points.groupBy("seq").count().collect())) == [(1, 10_000), (2, 30_000)]
    assert C.report_metrics(C.cube(spark, f"{scratch}/cube")).first().total_assets == 40_000


def test_nothing_committed(spark, scratch):
    with pytest.raises(FileNotFoundError):
        C.cube(spark, f"{scratch}/none")
    with pytest.raises(FileNotFoundError):
        C.points(spark, f"{scratch}/none")


def test_stream_of_readings(spark, scratch):
    rng = random.Random(3)
    for i in range(3):
        spark.createDataFrame([_reading(rng) for _ in range(20)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/in")
    C.start_cube_sink(stream, f"{scratch}/cube", f"{scratch}/check", ["seq"], buckets=4, trigger_once=True).awaitTermination()
    want = _full(spark.read.schema(SCHEMA).parquet(f"{scratch}/in"), True)
    assert _rows(C.commodity_risk(C.cube(spark, f"{scratch}/cube"))) == _rows(PF.commodity_risk(want))
