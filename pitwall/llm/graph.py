"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long, not null); root is the least node reachable.

    Each round is two joins on the edges; minima combine map-side and AQE splits
    a hub's partition.  The rounds are written to the shared folder and end when
    the edges no longer change; an empty table gives an empty table.
    """
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(*[F.struct(F.col(x).alias("u"), F.col("m").alias("v")) for x in ("v", "u")])
        small = large.join(least, "u").select(F.explode(pairs).alias("e")).select("e.*")
        edges = saved(small.filter("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            return edges.toDF("node", "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
