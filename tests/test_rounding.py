from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitwall.functions.core import clip, py_round

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
ties = st.integers(min_value=-10**6, max_value=10**6).map(lambda k: (k + 0.5) / 100)  # x.xx5 values


@settings(max_examples=25, deadline=None)
@given(st.lists(st.one_of(finite, ties), min_size=1, max_size=200))
def test_py_round_equals_python(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(py_round("x", 1).alias("r1"), py_round("x", 2).alias("r2")).collect()
    for x, r in zip(xs, got):
        assert r.r1 == round(x, 1), x
        assert r.r2 == round(x, 2), x


def test_py_round_null_and_clip_keep_null(spark):
    df = spark.createDataFrame([(None,), (70.0,), (-1.0,)], "x double")
    rows = df.select(py_round("x", 1).alias("r"), clip("x", 0.0, 50.0).alias("c")).collect()
    assert [r.r for r in rows] == [None, 70.0, -1.0]
    assert [r.c for r in rows] == [None, 50.0, 0.0]
    # Spark's own least/greatest would turn NULL into a number:
    assert df.select(F.least("x", F.lit(50.0))).first()[0] == 50.0
