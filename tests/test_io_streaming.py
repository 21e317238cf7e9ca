import datetime as dt
import json
import os

import pytest

from pitwall.operators import forecast as FC
from pitwall.operators import overrides as O
from pitwall.sources import io as IO
from pitwall.streaming import incremental as S

AS_OF = dt.date(2002, 1, 1)

# Invented rows; the second has a malformed next date, the third a malformed last date.
CSV = """id_number,average_corrosion_rate,thickness_mm,commodity,feature_type,cml_shape,last_inspection_date,next_inspection_date
LOOP-01,0.19,8.3,Condensate,Header,External,2019-02-03,2024-11-30
LOOP-02,0.04,13.1,Potable Water,Flange,Both,2018-10-22,2026-00-15
LOOP-03,0.33,4.7,Fuel Gas,Nozzle,Internal,not a date,2025-03-09
"""


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_points_csv_no_inference(spark, scratch):
    p = _write(f"{scratch}/in/points.csv", CSV)
    df = IO.read_points_csv(spark, p)
    types = dict(df.dtypes)
    assert types["average_corrosion_rate"] == "double" and types["next_inspection_date"] == "string"
    assert df.count() == 3
    fc = {r.id_number: r for r in FC.forecast_b(df, as_of=AS_OF).collect()}
    assert fc["LOOP-03"].next_inspection_date_forecast is not None  # malformed last date -> as_of


def test_write_predictions_guard(spark, scratch):
    empty = spark.createDataFrame([], "id_number string")
    with pytest.raises(ValueError):
        IO.write_predictions_csv(empty, f"{scratch}/out")
    df = spark.createDataFrame([("a",)], "id_number string")
    IO.write_predictions_csv(df, f"{scratch}/out")
    assert spark.read.option("header", True).csv(f"{scratch}/out").count() == 1


def test_overrides_json(spark, scratch):
    missing = IO.read_overrides_json(spark, f"{scratch}/nope.json")
    assert missing.count() == 0
    good = _write(f"{scratch}/ov/good.json", json.dumps([
        {"id_number": "LOOP-77", "sme_decision": "KEEP", "reason": "close to the furnace", "sme_name": "q",
         "override_date": "2021-03-04T05:06:07.080901", "original_prediction": None, "original_probability": None}]))
    r = IO.read_overrides_json(spark, good).first()
    assert r.override_date == dt.datetime(2021, 3, 4, 5, 6, 7, 80901)
    bad = _write(f"{scratch}/ov2/bad.json", "[{not json")
    with pytest.raises(ValueError):
        IO.read_overrides_json(spark, bad, strict=True)
    assert IO.read_overrides_json(spark, bad, strict=False).count() == 0


def test_override_log_append(spark, scratch):
    path = f"{scratch}/log"
    assert O.read_override_log(spark, path).count() == 0
    O.append_override_log(O.new_override(spark, "A", "KEEP", "a sufficiently long reason", "x"), path)
    O.append_override_log(O.new_override(spark, "A", "ELIMINATE", "a sufficiently long reason", "y",
                                         override_date=dt.datetime(2100, 1, 1)), path)
    cur = O.current_overrides(O.read_override_log(spark, path)).collect()
    assert len(cur) == 1 and cur[0].sme_decision == "ELIMINATE"


def test_report_json_and_preview(spark, scratch):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id_number string, v int")
    IO.write_report_json({"s": df}, f"{scratch}/rep")
    assert spark.read.json(f"{scratch}/rep/s").count() == 3
    prev = IO.dataset_preview(df, 2).collect()
    assert [r.id_number for r in prev] == ["a", "b"] and prev[0].total_rows == 3
    assert IO.report_as_json_column(df.limit(1)).first().json.startswith("{")


def test_streaming_forecast_equals_batch(spark, scratch):
    src = f"{scratch}/stream_in"
    _write(f"{src}/f1.csv", CSV)
    _write(f"{src}/f2.csv", CSV.replace("LOOP-0", "LOOP-1"))
    stream = S.forecast_files(spark, src, as_of=AS_OF)
    q = stream.writeStream.format("memory").queryName("fc_stream_test").outputMode("append") \
        .option("checkpointLocation", f"{scratch}/ckpt").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("fc_stream_test")
    batch = FC.forecast_b(IO.read_points_csv(spark, f"{src}/f1.csv"), as_of=AS_OF)
    assert got.count() == 6
    a = {r.id_number: r.remaining_life_years for r in got.collect()}
    b = {r.id_number: r.remaining_life_years for r in batch.collect()}
    assert all(a[k] == v for k, v in b.items())


def test_streaming_override_state(spark, scratch):
    log_dir = f"{scratch}/log_stream"
    t = dt.datetime
    first = spark.createDataFrame([("A", "KEEP", "reason long enough", "x", t(2024, 1, 1), None, None)],
                                  O.OVERRIDE_SCHEMA)
    first.write.parquet(f"{log_dir}/b1")
    state_dir = f"{scratch}/state"
    stream = S.current_override_state(spark.readStream.schema(O.OVERRIDE_SCHEMA).parquet(f"{log_dir}/*"))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", f"{scratch}/ckpt2") \
        .foreachBatch(lambda b, i: S.apply_state_batch(b, i, state_dir)).start()
    q.processAllAvailable()
    second = spark.createDataFrame([("A", "ELIMINATE", "reason long enough", "y", t(2024, 2, 1), None, None),
                                    ("B", "KEEP", "reason long enough", "y", t(2024, 2, 1), None, None)],
                                   O.OVERRIDE_SCHEMA)
    second.write.parquet(f"{log_dir}/b2")
    q.processAllAvailable()
    q.stop()
    cur = {r.id_number: r.sme_decision for r in S.latest_state(spark, state_dir).collect()}
    assert cur == {"A": "ELIMINATE", "B": "KEEP"}


def test_streaming_file_sink_exactly_once(spark, scratch):
    src = f"{scratch}/in"
    _write(f"{src}/a.csv", CSV)
    out, ckpt = f"{scratch}/out", f"{scratch}/ckpt"
    q = S.start_forecast_sink(S.forecast_files(spark, src, as_of=AS_OF), out, ckpt, trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    # a restart with no new files writes nothing more; a new file is processed once
    _write(f"{src}/b.csv", CSV.replace("LOOP-0", "LOOP-2"))
    q = S.start_forecast_sink(S.forecast_files(spark, src, as_of=AS_OF), out, ckpt, trigger_once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 6


def test_csv_bad_cells_and_nan(spark, scratch):
    p = _write(f"{scratch}/in/bad.csv", "id_number,average_corrosion_rate,thickness_mm,commodity\n"
                                        "a,abc,9.0,Gas\nb,NaN,8.0,Gas\nc,0.1,7.0,Gas\n")
    r = {x.id_number: x for x in IO.read_points_csv(spark, p).collect()}
    assert r["a"].average_corrosion_rate is None and r["a"].thickness_mm == 9.0 and r["a"]._corrupt_record == "a,abc,9.0,Gas"
    assert r["b"].average_corrosion_rate is None and r["b"]._corrupt_record is None and r["c"]._corrupt_record is None
    fc = {x.id_number: x for x in FC.forecast_b(IO.read_points_csv(spark, p), as_of=AS_OF).collect()}
    assert fc["b"].remaining_life_years is None and fc["b"].risk_level is None


def test_export_full_dataset(spark, scratch):
    df = spark.createDataFrame([("b", 1.5), ("a", None)], "id_number string, v double")
    IO.export_full_dataset(df, f"{scratch}/all")
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"{scratch}/all").collect())) == [("a", None), ("b", "1.5")]


def _entries(spark, *rows):
    return spark.createDataFrame([(i, d, "reason long enough", "x", t, None, None) for i, d, t in rows], O.OVERRIDE_SCHEMA)


def test_state_survives_replay_and_rewrites_only_touched_buckets(spark, scratch):
    import glob

    target, t = f"{scratch}/state", dt.datetime
    first = O.current_overrides(_entries(spark, *[(f"id{i}", "KEEP", t(2024, 1, 1)) for i in range(40)]))
    S.apply_state_batch(first, 0, target, buckets=8)
    for _ in range(2):  # the second time as a replay
        S.apply_state_batch(O.current_overrides(_entries(spark, ("id3", "ELIMINATE", t(2024, 2, 1)))), 1, target, buckets=8)
        got = {r.id_number: r.sme_decision for r in S.latest_state(spark, target).collect()}
        assert len(got) == 40 and got["id3"] == "ELIMINATE" and got["id4"] == "KEEP"
    assert len(glob.glob(f"{target}/v=1/bucket=*")) == 1
    for k in range(2, 6):
        S.apply_state_batch(O.current_overrides(_entries(spark, ("id3", "KEEP", t(2024, 3, k)))), k, target, buckets=8)
    bucket = glob.glob(f"{target}/v=5/bucket=*")[0].rpartition("=")[2]
    assert len(glob.glob(f"{target}/v=*/bucket={bucket}")) == 2  # older versions are gone
    assert S.latest_state(spark, target).count() == 40


def test_removal_survives_a_reread(spark, scratch):
    path, t = f"{scratch}/log", dt.datetime
    O.append_override_log(_entries(spark, ("A", "KEEP", t(2024, 1, 1)), ("B", "KEEP", t(2024, 1, 1))), path)
    O.append_override_log(O.removals(spark.createDataFrame([("A",)], "id_number string"), t(2024, 2, 1)), path)
    assert [r.id_number for r in O.current_overrides(O.read_override_log(spark, path)).collect()] == ["B"]
    O.append_override_log(_entries(spark, ("A", "ELIMINATE", t(2024, 3, 1))), path)
    assert {r.id_number for r in O.current_overrides(O.read_override_log(spark, path)).collect()} == {"A", "B"}


def test_latest_entry_does_not_follow_the_time_zone(spark):
    t = dt.datetime
    log = _entries(spark, ("A", "KEEP", t(2024, 3, 10, 2, 50)), ("A", "ELIMINATE", t(2024, 3, 10, 3, 10)))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert O.current_overrides(log).first().sme_decision == "ELIMINATE"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
