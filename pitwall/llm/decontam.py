"""Benchmark decontamination by spaced seeds (native DataFrame code only).

Texts are lower-cased and cut into tokens (runs of letters and digits).  At
every token a fixed mask of eight positions picks six of them, and their hash is
joined with the same hashes of the benchmark.  The two masks were chosen so that
any 13 aligned tokens with at most two substitutions contain an untouched mask
(a test enumerates all cases).  An item of 8 to 12 tokens has masks of its own
over its whole length: it is cut into two parts more than it may have
substitutions, so two parts are untouched, and every pair of parts is a mask.  An
item of fewer tokens has one mask, all of it.  Each hit gives an alignment of a
document with an item, which is verified token by token: a leak is a window of 13
aligned tokens (the whole item if it has fewer) of which at least ``MIN_SHARE``
agree, and all of them if the item has fewer than eight.

The benchmark's hashes are broadcast if there are at most ``MAX_BROADCAST``;
beyond that they are joined by a shuffle, whose hot keys AQE splits.  A
document's rows in that join hold its key, a position and a hash; the alignments
found, each once, are joined back to the documents by key for their tokens.

Null and empty texts have no tokens and no leaks.  A document's masks for short
items are only those of the lengths that the benchmark has.
Repeated rows and ties give one row for an id and item; empty tables give an
empty table; very long texts are searched whole.  Columns other than id and text
are not read, and are passed through by ``drop_leaks`` whatever their names.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, maybe_broadcast, saved, table

# positions that count; the others may differ
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
MIN_SHARE = 80  # per cent of a window's tokens that agree: 11 of 13
MAX_BROADCAST = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks of an item of ``n`` tokens, fewer than ``WINDOW``, from its first token on."""
    if n < SPAN:
        return (tuple(range(n)),)
    parts = n * (100 - MIN_SHARE) // 100 + 2
    cuts = [range(n * k // parts, n * (k + 1) // parts) for k in range(parts)]
    return tuple((*x, *y) for x, y in itertools.combinations(cuts, 2))


def seeds(df: DataFrame, short: list[int], items: bool = False) -> DataFrame:
    """Rows of ``df`` (with an array column _d_w) for each token and mask: _d_p, _d_h.

    ``short`` are the lengths below ``WINDOW`` that items have; of ``items``, each has the masks of its own length.
    """
    # outer: an inner explode would have the tokens computed a second time for its filter
    at = df.select("*", F.posexplode_outer("_d_w").alias("_d_p", "_d_first"))
    size, p = F.size("_d_w"), F.col("_d_p")

    def hashed(mask: tuple[int, ...], *tag: int) -> Column:
        return F.xxhash64(*map(F.lit, tag), *[F.get("_d_w", p + o) for o in mask])

    fits = (p + SPAN <= size) & (size >= WINDOW) if items else p + SPAN <= size
    hashes = [F.when(fits, hashed(m, k)) for k, m in enumerate(MASKS)]
    for n in short:
        fits = (p == 0) & (size == n) if items else p + n <= size
        hashes += [F.when(fits, hashed(m, k, n)) for k, m in enumerate(short_masks(n))]
    inside = at.filter(p + min([SPAN, *short]) <= size).drop("_d_first")
    return inside.select("*", F.explode(F.array(*hashes)).alias("_d_h")).filter("_d_h IS NOT NULL")


def _best(agree: Column, size: Column) -> Column:
    """(agreeing tokens, first token) of the best window of ``size`` in an array of 0 and 1; null if it is shorter."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(agree) - size + 1),
        lambda i: F.struct(F.aggregate(F.slice(agree, i, size), F.lit(0), lambda a, b: a + b).alias("n"), (-i).alias("at")),
    )
    return F.when(F.size(agree) >= size, F.array_max(windows))


def alignments(words: DataFrame, keys: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, _d_text, item_id, _d_n, _d_at): where documents' seeds meet an item's, each once."""
    at = seeds(words, short).select("doc_id", "_d_text", "_d_p", "_d_h")
    return at.join(keys, "_d_h").select("doc_id", "_d_text", "item_id", "_d_n", (F.col("_d_p") - F.col("_d_ip")).alias("_d_at")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, _d_text, item_id, start, matched): the best window of each document (id and text hash) and item.

    ``start`` is the window's first token in the document, ``matched`` how many of its tokens agree.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("_d_w")).filter(F.size("_d_w") > 0).distinct()
    items = saved(items, "benchmark-items")
    lengths = sorted(r["n"] for r in items.select(F.size("_d_w").alias("n")).filter(F.col("n") < WINDOW).distinct().collect())
    keys = seeds(items, lengths, items=True).select("item_id", F.col("_d_p").alias("_d_ip"), F.size("_d_w").alias("_d_n"), "_d_h", F.col("_d_w").alias("_d_item"))
    keys = saved(keys.withColumn("_d_item", F.array_join("_d_item", " ")).distinct(), "benchmark-seeds")
    short = maybe_broadcast(keys.select("item_id", "_d_ip", "_d_n", "_d_h"), MAX_BROADCAST)
    words = docs.select("doc_id", F.xxhash64("text").alias("_d_text"), tokens(F.col("text")).alias("_d_w"))
    found = maybe_broadcast(saved(alignments(words, short, lengths), "alignments"), MAX_BROADCAST)
    found = found.withColumnsRenamed({"doc_id": "_d_id", "_d_text": "_d_th"})
    at = F.col("_d_at")
    aligned = words.join(found, words["doc_id"].eqNullSafe(found["_d_id"]) & (words["_d_text"] == found["_d_th"])).select(
        "doc_id", "_d_text", "item_id", "_d_n", "_d_at",
        F.array_join(F.slice("_d_w", F.greatest(at, F.lit(0)) + 1, F.col("_d_n") + F.least(at, F.lit(0))), " ").alias("_d_part"),
    )
    texts = maybe_broadcast(keys.select("item_id", F.col("_d_item")).distinct(), MAX_BROADCAST // 10)
    part, item = F.split("_d_part", " "), F.split("_d_item", " ")
    skip = F.greatest(-F.col("_d_at"), F.lit(0))  # item tokens before the document begins
    agree = F.zip_with(part, F.slice(item, skip + 1, F.size(part)), lambda a, b: F.when(a == b, 1).otherwise(0))
    size = F.least(F.col("_d_n"), F.lit(WINDOW))
    checked = (
        aligned.join(texts, "item_id")
        .filter(F.size(item) == F.col("_d_n"))
        .select("doc_id", "_d_text", "item_id", (F.col("_d_at") + skip).alias("_d_at"), let(agree, lambda x: F.struct(
            size.alias("size"), _best(x, size).alias("best"))).alias("_d_v"))
        .filter(100 * F.col("_d_v.best.n") >= F.when(F.col("_d_v.size") < SPAN, 100).otherwise(MIN_SHARE) * F.col("_d_v.size"))
    )
    best = F.max(F.struct("_d_v.best.n", (-(F.col("_d_at") - F.col("_d_v.best.at") - 1)).alias("at")))
    return checked.groupBy("doc_id", "_d_text", "item_id").agg(best.alias("b")).select(
        "doc_id", "_d_text", "item_id", (-F.col("b.at")).cast("long").alias("start"), F.col("b.n").cast("long").alias("matched")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a passage of ``benchmark``; nulls and clean texts stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("_d_id"), F.col("_d_text").alias("_d_th")).distinct()
    marked = docs.select("doc_id", F.xxhash64("text").alias("_d_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_d_row"))
    bad = marked["doc_id"].eqNullSafe(found["_d_id"]) & (marked["_d_text"] == found["_d_th"])
    return marked.join(found, bad, "left_anti").select("_d_row.*")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("matched", (-F.col("start")).alias("at"))).alias("b")
    ).select("doc_id", "item_id", (-F.col("b.at")).alias("start"), "b.matched")


_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
# Without seeds: an accepted window of eight tokens or more holds three agreeing tokens in a row (13 tokens with two
# substitutions have a run of four), so shared runs of three give every alignment; shorter items agree from their first token on.
OP6_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id AS id, {_TOKENS} AS w FROM documents), i AS (SELECT DISTINCT item_id AS id, {_TOKENS} AS w FROM benchmark),
dp AS (SELECT *, unnest(range(0, len(w))) AS p FROM d), ip AS (SELECT *, unnest(range(0, len(w))) AS p FROM i),
runs AS (SELECT id, w, p, concat_ws(' ', w[p + 1], w[p + 2], w[p + 3]) AS h FROM ip WHERE len(w) >= {SPAN} AND p + 3 <= len(w)),
al AS (SELECT DISTINCT dp.id AS doc_id, runs.id AS item_id, dp.p - runs.p AS g, dp.w AS dw, runs.w AS iw
       FROM dp JOIN runs ON concat_ws(' ', dp.w[dp.p + 1], dp.w[dp.p + 2], dp.w[dp.p + 3]) = runs.h WHERE dp.p + 3 <= len(dp.w)
       UNION SELECT dp.id, ip.id, dp.p, dp.w, ip.w FROM dp JOIN ip ON dp.w[dp.p + 1] = ip.w[1] WHERE ip.p = 0 AND len(ip.w) < {SPAN}),
ov AS (SELECT *, greatest(g, 0) AS f, least(len(dw), g + len(iw)) - greatest(g, 0) AS n, least(len(iw), {WINDOW}) AS size FROM al),
wi AS (SELECT *, unnest(range(0, CAST(n - size + 1 AS BIGINT))) AS q FROM ov WHERE n >= size),
ma AS (SELECT doc_id, item_id, f + q AS start, size,
       len(list_filter(range(0, CAST(size AS BIGINT)), lambda j: dw[f + q + j + 1] = iw[f + q + j + 1 - g])) AS matched FROM wi),
ok AS (SELECT * FROM ma WHERE 100 * matched >= CASE WHEN size < {SPAN} THEN 100 ELSE {MIN_SHARE} END * size)
SELECT doc_id, item_id, start, matched FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) AS r FROM ok) WHERE r = 1
"""
