"""Null-safe scalar helpers shared by every rule.

Spark's ``least``/``greatest`` skip NULL (``least(NULL, 50) = 50``) and order
NaN above every number, while the original pandas ``clip`` keeps a missing value
missing.  NaN and NULL both mean "not measured": :func:`normalise` turns NaN into
NULL where data enter, and every cap, floor and band here treats a NaN that got
past it as missing, so a missing measurement never becomes the safest answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import saved


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float | Column) -> Column:
    """A double literal (never a decimal literal), or a column as double."""
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def null_double() -> Column:
    return F.lit(None).cast("double")


def missing(c: str | Column) -> Column:
    """NULL or NaN."""
    c = col(c)
    return c.isNull() | F.isnan(c)


def normalise(df: DataFrame) -> DataFrame:
    """NaN to NULL in every double and float column (a narrow projection; other columns untouched)."""
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not kinds:
        return df
    return df.withColumns({n: F.nanvl(df[n], F.lit(None).cast(t)) for n, t in kinds.items()})


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to [lo, hi]; NULL and NaN give NULL."""
    c = col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, dbl(lo))
    if hi is not None:
        out = F.least(out, dbl(hi))
    return F.when(missing(c), null_double()).otherwise(out)


def trunc_int(c: Column) -> Column:
    """Python ``int()`` on a non-negative double: truncation toward zero."""
    return F.when(c.isNull(), F.lit(None).cast("bigint")).otherwise(
        F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))
    )


def flag(cond: Column) -> Column:
    """0/1 integer of a condition; NULL comparisons count as 0 (pandas NaN rule)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    """Rows where cond is true (NULL counts as false), as bigint."""
    return F.count(F.when(cond, F.lit(1)))


def r6(c: Column) -> Column:
    """Round aggregate doubles to 6 decimals before comparison."""
    return F.round(c, 6)


def band(c: Column, bins) -> Column:
    """Label of the bin holding ``c``.

    ``bins`` is a sequence of (lo, hi, label) with hi None meaning +inf, and
    pandas ``cut`` semantics (lo, hi]; values at or below the first edge, NULL
    and NaN fall out (NULL label).
    """
    expr = F.when(F.isnan(c), F.lit(None).cast("string"))
    for lo, hi, label in bins:
        cond = c > dbl(lo)
        if hi is not None:
            cond = cond & (c <= dbl(hi))
        expr = expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(None).cast("string"))


def step_index(c: Column, upper_edges) -> Column:
    """Index of a half-open step [edge_{i-1}, edge_i): 0 below the first edge."""
    expr = None
    for i, edge in enumerate(upper_edges):
        expr = F.when(c < dbl(edge), F.lit(i)) if expr is None else expr.when(c < dbl(edge), F.lit(i))
    return F.when(missing(c), F.lit(None).cast("int")).otherwise(expr.otherwise(F.lit(len(upper_edges))))


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp splitting constant for doubles


def py_round(c: str | Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` on doubles, exactly, with built-in expressions.

    Python rounds the exact binary value half-to-even (``round(3.045, 2)`` is
    3.04 because 3.045 is stored as 3.04499...), while Spark's ``round``
    rounds the shortest decimal form half-up (3.05).  Here ``p = x * 10^d``
    is computed together with its exact rounding error ``e`` (Dekker's
    error-free product; ``10^d`` splits exactly).  ``p`` can only sit on a
    .5 tie when the exact product is at or next to it, so the sign of ``e``
    decides ties and half-even is used only for exact ties.  Pass a column
    reference (or stage the value first): the input is referenced many times.
    """
    x = col(c)
    scale = float(10 ** digits)
    p = x * dbl(scale)
    big = x * dbl(_SPLIT)
    hi = big - (big - x)
    lo = x - hi
    err = (hi * dbl(scale) - p) + lo * dbl(scale)
    k = F.floor(p)
    frac = p - k
    up = (
        F.when(frac > dbl(0.5), F.lit(1))
        .when(frac < dbl(0.5), F.lit(0))
        .when(err > dbl(0.0), F.lit(1))
        .when(err < dbl(0.0), F.lit(0))
        .otherwise(F.pmod(k, F.lit(2)).cast("int"))
    )
    return F.when(x.isNull() | F.isnan(x), x).otherwise((k + up).cast("double") / dbl(scale))


def literal_rows(spark, rows, ddl: str):
    """A small fixed table built JVM-side (inline of literal structs).

    Used for bin dimensions and other fixed-size lookup rows; unlike
    ``createDataFrame`` on a Python list it needs no Python worker and plans
    as a local relation.  ``ddl`` is "name type, name type, ...".
    """
    fields = [f.strip().split() for f in ddl.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def zero_filled_counts(keyed, dim, keys, attrs=(), count_name: str = "n_points", sums=()):
    """Counts of ``keyed`` rows per key, for exactly the keys listed in ``dim``.

    ``keyed`` holds one row per data row with the key column(s); ``dim`` holds
    the fixed key list plus display attributes.  Both are unioned (dimension
    rows count 0) and aggregated once, with partial aggregation before the
    shuffle.  Keys absent from the data get 0; data keys outside the
    dimension (e.g. NULL = out of every bin) are dropped by a condition on an
    aggregate.  No join is used: an equi-join would make the optimizer infer
    ``key IS NOT NULL`` and push it below the projection that computes the
    key, re-evaluating the whole key expression inside the filter.  ``sums``
    names numeric columns of ``keyed`` to total per key as ``sum_<name>``.
    """
    data = keyed.select(*keys, *[F.lit(None).cast(dict(dim.dtypes)[a]).alias(a) for a in attrs],
                        *[F.col(c) for c in sums], F.lit(1).alias("_n"), F.lit(0).alias("_dim"))
    fixed = dim.select(*keys, *attrs, *[F.lit(None).cast("double").alias(c) for c in sums],
                       F.lit(0).alias("_n"), F.lit(1).alias("_dim"))
    agg = data.unionByName(fixed).groupBy(*keys).agg(
        *[F.max(a).alias(a) for a in attrs],
        *[F.sum(c).alias(f"sum_{c}") for c in sums],
        F.sum("_n").cast("bigint").alias(count_name),
        F.max("_dim").alias("_in_dim"),
    )
    return agg.where(F.col("_in_dim") == 1).drop("_in_dim")


def exact_quantiles(df: DataFrame, columns: dict[str, Column], probs: dict[str, list[float]],
                    by: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation, like pandas): one row per value of ``by`` (or one row).

    The row holds an array of doubles per name in ``columns``.  No task holds
    a group's values: they are counted per distinct value (combined map-side),
    range-partitioned by (name, group, value) and written; each part's total
    per group is a small table, whose running sums number the values; then only
    the wanted ranks are read.  NULL and NaN are left out; a group without
    values is absent.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("v")) for n, c in columns.items()]))
    keyed = df.select((F.col(by) if by else F.lit(None).cast("string")).alias("g"), entries.alias("e"))
    counts = (keyed.select("g", "e.name", "e.v").where(~missing("v"))
              .groupBy("name", "g", "v").agg(F.count(F.lit(1)).alias("n")))
    order = ["name", "g", "v"]
    parts = saved(counts.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "quantile-counts")
    totals = parts.groupBy("name", "g", "part").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("name", "g")
    before = totals.select(  # a row per part and group
        F.col("name").alias("t_name"), F.col("g").alias("t_g"), F.col("part").alias("t_part"),
        F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(group).alias("total"))
    same = ((F.col("name") == F.col("t_name")) & F.col("g").eqNullSafe(F.col("t_g")) & (F.col("part") == F.col("t_part")))
    upto = F.sum("n").over(Window.partitionBy("part", "name", "g").orderBy("v"))
    ranked = parts.withColumn("upto", upto).join(before, same).withColumn("upto", F.col("upto") + F.col("before"))

    def value(p: float) -> Column:
        at = (F.col("total") - 1) * dbl(p)
        lo = F.min(F.when(F.col("upto") > F.floor(at), F.col("v")))
        hi = F.min(F.when(F.col("upto") > F.ceil(at), F.col("v")))
        f = F.first(at - F.floor(at))
        return F.when(lo == hi, lo).otherwise((dbl(1.0) - f) * lo + f * hi)

    every = sorted({p for ps in probs.values() for p in ps})
    found = ranked.groupBy("name", "g").agg(*[value(p).alias(f"q{i}") for i, p in enumerate(every)])
    lists = [
        F.first(F.when(F.col("name") == n, F.array(*[F.col(f"q{every.index(p)}") for p in probs[n]])), ignorenulls=True).alias(n)
        for n in columns
    ]
    return found.groupBy("g").agg(*lists).withColumnRenamed("g", by) if by else found.agg(*lists)
