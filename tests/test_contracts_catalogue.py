"""Contracts as data; write, audit, publish; the model catalogue."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitwall.operators import contracts as C
from pitwall.operators import features as FT
from pitwall.operators import model as M
from pitwall.operators import synth as G
from pitwall.sources import catalogue as K

ROW = dict(id_number="a", average_corrosion_rate=0.1, thickness_mm=8.0, commodity="Gas", feature_type="Pipe", cml_shape="Both")
SCHEMA = "id_number string, average_corrosion_rate double, thickness_mm double, commodity string, feature_type string, cml_shape string"


def frame(spark, *changes):
    rows = [tuple({**ROW, "id_number": f"p{i}", **c}.values()) for i, c in enumerate(changes)]
    return spark.createDataFrame(rows, SCHEMA)


def broken(report):
    return {(r.contract, r.rule): (r.n_violations, r.example) for r in report.collect() if r.n_violations}


def test_every_rule_of_the_points_contract(spark):
    df = frame(spark, {}, {"average_corrosion_rate": -0.1}, {"average_corrosion_rate": float("nan")}, {"average_corrosion_rate": 5.1}, {"thickness_mm": 0.0},
               {"thickness_mm": 50.5}, {"thickness_mm": None}, {"commodity": ""}, {"commodity": None}, {"feature_type": "Box"}, {"cml_shape": None}, {"id_number": None})
    got = broken(C.contract_report(df, C.default_rules(spark), "points", "forecast", "training"))
    assert got == {
        ("points", "average_corrosion_rate low"): (1, "p1"), ("points", "average_corrosion_rate missing"): (1, "p2"), ("points", "average_corrosion_rate high"): (1, "p3"),
        ("points", "thickness_mm low"): (1, "p4"), ("points", "thickness_mm high"): (1, "p5"), ("points", "thickness_mm missing"): (1, "p6"),
        ("points", "commodity empty"): (2, "p7"), ("points", "feature_type unknown"): (1, "p9"), ("points", "cml_shape unknown"): (1, "p10"), ("points", "id_number missing"): (1, None),
        ("training", "elimination_flag present"): (12, "p0"), ("training", "last_inspection_date present"): (12, "p0")}


def test_own_rules_dates_empty_tables_and_one_scan(spark, tmp_path):
    rules = spark.createDataFrame([("x", "when", "d", "date", None, "error"), ("x", "short", "d", "min_length", "9", "warning")], ", ".join(f"{c} string" for c in C.RULE_COLUMNS))
    spark.createDataFrame([("1", "2024-02-30"), ("2", "2024-02-29"), ("3", None), ("4", "soon")], "id_number string, d string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    report = C.contract_report(df, rules, "x")
    assert broken(report) == {("x", "when"): (2, "1"), ("x", "short"): (2, "3")}
    assert C.contract_report(df, rules, "x")._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
    assert [r.n_violations for r in C.contract_report(df.limit(0), rules, "x").collect()] == [0, 0]
    assert C.contract_report(df, rules, "none").collect() == []
    with pytest.raises(ValueError, match="unknown op"):
        C.contract_report(df, rules.withColumn("op", F.lit("like")), "x")


def test_only_a_table_that_keeps_the_contract_is_published(spark, scratch):
    base, rules = f"{scratch}/points", C.default_rules(spark)
    with pytest.raises(FileNotFoundError):
        K.read_published(spark, base)
    first = K.publish(frame(spark, {}, {"cml_shape": "Odd"}), base, rules, "points")
    assert (first["rows"], first["errors"], first["warnings"]) == (2, 0, 1)
    for bad in (frame(spark, {}, {"thickness_mm": -1.0}, {"commodity": ""}), frame(spark)):
        with pytest.raises(K.ContractViolation) as failed:
            K.publish(bad, base, rules, "points")
        assert failed.value.counts["errors"] in (0, 2)
        assert K.current(spark, base) == first["version"] and K.read_published(spark, base).count() == 2
    assert K.publish(frame(spark, {}, {"thickness_mm": -1.0}, {}), base, rules, "points", allowed=1)["errors"] == 1
    assert K.read_published(spark, base).count() == 3
    assert K.sweep(spark, base, keep=1) == [first["version"]] and K.read_published(spark, base).count() == 3


def test_the_audit_reads_the_table_once(spark, scratch):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    K.publish(frame(spark, {}, {}, {}).mapInArrow(counted, SCHEMA), f"{scratch}/once", C.default_rules(spark), "points", format="csv", header=True)
    assert reads.value == 3
    assert K.read_published(spark, f"{scratch}/once", "csv", header=True).count() == 3


def test_a_crash_between_the_writes_leaves_the_old_model(spark, scratch, monkeypatch):
    table = FT.scoring_features(G.generate_range(spark, 200, as_of=dt.date(2002, 1, 1), seed=3), dt.date(2002, 1, 1), keep=("id_number", M.LABEL))
    old = M.build_pipeline(table, num_trees=2, max_depth=2).fit(table)
    new = M.build_pipeline(table, num_trees=3, max_depth=2).fit(table)
    names = M.numeric_features(table)
    M.save_model(old, scratch, {}, names, timestamp="1")
    trees = lambda: M.load_model(f"{scratch}/latest").stages[-1].getNumTrees
    assert trees() == 2

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(K, "point", crash)
        with pytest.raises(RuntimeError):
            M.save_model(new, scratch, {}, names, timestamp="2")
    assert trees() == 2
    M.save_model(new, scratch, {}, names, timestamp="3")
    assert trees() == 3 and M.load_model(K.version_path(scratch, "model_1")).stages[-1].getNumTrees == 2
