"""License scans: MinHash bands over overlapping windows, then exact containment (native code only).

Texts are lower-cased and cut into words (runs of letters and digits) and
five-word shingles.  Each template has a size class C, the power of two at or
above its word count (so it has more than C/2 words).  Windows of a class are
5C/4 words long and begin every C/4 words, so any passage of at most C words lies
whole in one of them.  An exact join of the shingles comes first: windows without
any template's shingle have containment zero and are not hashed.  The others get
MinHash bands of one minimum each, in every class so many that a window in which
``CONTAINED`` of a template's shingles stand collides with it but for a chance of
``MISSED``; a five-word template, one shingle among a window's six (Jaccard
similarity 1/6), takes 114.  Windows that collide with a template in a band are
verified: the share of the template's shingles that stand in the window.

Templates are a small table; their shingles are broadcast if there are at most
``MAX_BROADCAST``, else joined by a shuffle whose hot keys AQE splits.  A
document's rows in that join hold its key, a position and a hash; the windows
found, each once, are joined back to the documents by key for their words.

Licenses whose templates share half of their shingles (versions of one notice)
are siblings: where the windows of two overlap, the one with the larger share of
its template stays.

Null and empty texts have no words and no licenses; very long texts and templates
of any length are searched whole.  Templates of fewer than
five words have no shingle and are not searched.  Repeated rows and ties give
one row for an id and license (best containment, then first place); empty
tables give an empty table.  Columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, maybe_broadcast, saved, table
from .license_texts import TEMPLATES

SHINGLE = 5
CONTAINED = 80  # per cent
MISSED = 1e-9
MAX_BROADCAST = 200_000
SIBLING = 50  # per cent of the smaller template's shingles that siblings share


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template_id int, license string, text string")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _shingles(w: Column) -> Column:
    """The distinct shingles of an array of at least five words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def bands_for(size: int, n: int) -> int:
    """Bands that a template of ``n`` shingles needs in the windows of class ``size``."""
    inside = -(-n * CONTAINED // 100)
    jaccard = inside / (size * 5 // 4 - (SHINGLE - 1) + n - inside)
    return math.ceil(math.log(MISSED) / math.log1p(-jaccard))


def _bands(shingles: Column, n: Column) -> Column:
    """The least hash of the shingles in each of ``n`` bands."""
    return F.transform(F.sequence(F.lit(1), n), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(b, s))))


def prepared(templates: DataFrame) -> DataFrame:
    """(template_id, license, class, shingles) of the templates that can be searched."""
    w = templates.select("template_id", "license", words(F.col("text")).alias("_l_w")).filter(F.size("_l_w") >= SHINGLE)
    size = F.greatest(F.lit(8), F.call_function("shiftleft", F.lit(1), F.length(F.bin(F.size("_l_w") - 1))))  # of any length
    return w.select("template_id", "license", size.alias("class"), let(F.col("_l_w"), _shingles).alias("shingles"))


def spots(text: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, _l_text, class, _l_k): the windows in which a template's shingle stands, each once."""
    # outer: an inner explode would have the words computed a second time for its filter
    at = text.select("*", F.posexplode_outer("_l_w").alias("_l_p", "_l_first")).filter(F.col("_l_p") + SHINGLE <= F.size("_l_w"))
    joined = [F.get("_l_w", F.col("_l_p") + k) for k in range(SHINGLE)]
    hits = at.select("doc_id", "_l_text", "_l_p", F.xxhash64(F.concat_ws(" ", *joined)).alias("_l_h")).join(marks, "_l_h")
    step, size = F.col("class") / 4, F.col("class") * 5 / 4
    first = F.greatest(F.ceil((F.col("_l_p") + SHINGLE - size) / step), F.lit(0))
    return hits.select("doc_id", "_l_text", "class", F.explode(F.sequence(first, F.floor(F.col("_l_p") / step))).alias("_l_k")).distinct()


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, license, matched, total, first_word): the best window of each document and license."""
    known = saved(prepared(templates), "licenses")
    marks = saved(known.select("class", F.explode("shingles").alias("s")).select("class", F.xxhash64("s").alias("_l_h")).distinct(), "license-shingles")
    text = docs.select("doc_id", F.xxhash64("text").alias("_l_text"), words(F.col("text")).alias("_l_w"))
    found = saved(spots(text, maybe_broadcast(marks, MAX_BROADCAST)), "license-windows")
    found = maybe_broadcast(found, MAX_BROADCAST).withColumnsRenamed({"doc_id": "_l_id", "_l_text": "_l_th"})
    step, size = F.col("class") / 4, F.col("class") * 5 / 4
    windows = (
        text.join(found, text["doc_id"].eqNullSafe(found["_l_id"]) & (text["_l_text"] == found["_l_th"]))
        .select("doc_id", "_l_text", "class", "_l_k", F.array_join(F.slice("_l_w", (F.col("_l_k") * step).cast("int") + 1, size.cast("int")), " ").alias("_l_part"))
        .distinct()
    )
    least = known.groupBy("class").agg(F.min(F.size("shingles")).alias("n")).collect()  # a row per class
    n_bands = F.lit(1)
    for r in least:
        n_bands = F.when(F.col("class") == r["class"], F.lit(bands_for(r["class"], r["n"]))).otherwise(n_bands)
    own = windows.select("doc_id", "_l_text", "class", (F.col("_l_k") * step).cast("long").alias("first_word"), let(F.split("_l_part", " "), _shingles).alias("_l_s"))
    keys = own.withColumn("_l_b", F.explode(F.arrays_zip(F.sequence(F.lit(1), n_bands).alias("band"), _bands(F.col("_l_s"), n_bands).alias("least"))))
    bands = known.select("template_id", F.col("class").alias("_l_class"), F.posexplode(_bands(F.col("shingles"), n_bands)).alias("band", "least"))
    same = (F.col("class") == F.col("_l_class")) & (F.col("_l_b.band") == F.col("band") + 1) & (F.col("_l_b.least") == F.col("least"))
    met = keys.join(maybe_broadcast(bands, MAX_BROADCAST), same).select("doc_id", "_l_text", "first_word", "_l_s", "template_id").distinct()
    checked = met.join(maybe_broadcast(known.select("template_id", "license", "class", "shingles"), MAX_BROADCAST // 20), "template_id").select(
        "doc_id", "_l_text", "license", "class", "first_word", F.size(F.array_intersect("_l_s", "shingles")).cast("long").alias("matched"),
        F.size("shingles").cast("long").alias("total")
    )
    best = F.max(F.struct((F.col("matched") / F.col("total")).alias("share"), "matched", "total", (-F.col("first_word")).alias("at"), "class"))
    per_text = checked.filter(100 * F.col("matched") >= CONTAINED * F.col("total")).groupBy("doc_id", "_l_text", "license").agg(best.alias("b"))
    hits = saved(per_text, "license-hits")
    pairs = maybe_broadcast(saved(siblings(known), "license-siblings"), MAX_BROADCAST)
    apart = F.abs(F.col("b.at") - F.col("o.at")) < F.greatest("b.class", "o.class") * 5 / 4
    other = hits.select(F.col("doc_id").alias("_l_id"), F.col("_l_text").alias("_l_th"), F.col("license").alias("sibling"), F.col("b").alias("o"))
    beaten = (
        hits.join(pairs, "license").join(other, F.col("doc_id").eqNullSafe(F.col("_l_id")) & (F.col("_l_text") == F.col("_l_th")) & (pairs["sibling"] == other["sibling"]))
        .filter((F.col("o.share") > F.col("b.share")) & apart).select(F.col("doc_id").alias("_l_id"), F.col("_l_text").alias("_l_th"), F.col("license").alias("_l_l")).distinct()
    )
    same = hits["doc_id"].eqNullSafe(beaten["_l_id"]) & (hits["_l_text"] == beaten["_l_th"]) & (hits["license"] == beaten["_l_l"])
    return (
        hits.join(beaten, same, "left_anti").groupBy("doc_id", "license").agg(F.max("b").alias("b"))
        .select("doc_id", "license", "b.matched", "b.total", (-F.col("b.at")).alias("first_word"))
    )


def siblings(known: DataFrame) -> DataFrame:
    """(license, sibling): licenses with templates that share ``SIBLING`` per cent of the smaller one's shingles."""
    each = known.select("template_id", "license", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    other = each.toDF("t2", "sibling", "n2", "s")
    shared = each.join(other, "s").filter("license <> sibling").groupBy("template_id", "t2", "license", "sibling").agg(
        F.count("*").alias("shared"), F.first(F.least("n", "n2")).alias("least"))
    return shared.filter(100 * F.col("shared") >= SIBLING * F.col("least")).select("license", "sibling").distinct()


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), default_templates(spark))


_VALUES = ", ".join("({}, '{}', '{}')".format(i, a, t.replace("'", "''")) for i, (a, t) in enumerate(TEMPLATES))
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
OP10_SQL = f"""
WITH tpl AS (SELECT id, license, {_WORDS} AS w FROM (VALUES {_VALUES}) v(id, license, text)),
ts AS (SELECT DISTINCT id, license, len(w) AS n, array_to_string(w[p:p + {SHINGLE - 1}], ' ') AS s
       FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS p FROM tpl WHERE len(w) >= {SHINGLE})),
tc AS (SELECT *, greatest(8, 1 << length(bin(n - 1))) AS c, count(*) OVER (PARTITION BY id) AS total FROM ts),
sib AS (SELECT DISTINCT a.license, b.license AS sibling FROM tc a JOIN tc b ON a.s = b.s AND a.license <> b.license
        GROUP BY a.id, b.id, a.license, b.license, a.total, b.total HAVING 100 * count(*) >= {SIBLING} * least(a.total, b.total)),
ds AS (SELECT doc_id, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, p, id, license, c, total, ds.s, unnest(range(CAST(greatest(ceil((p + {SHINGLE} - 1.25 * c) / (c / 4.0)), 0) AS BIGINT), CAST(floor(p / (c / 4.0)) AS BIGINT) + 1)) AS k
        FROM ds JOIN tc ON ds.s = tc.s),
win AS (SELECT doc_id, id, license, c, total, c // 4 * k AS first_word, count(DISTINCT s) AS matched FROM hit GROUP BY ALL),
ok AS (SELECT * FROM win WHERE 100 * matched >= {CONTAINED} * total),
best AS (SELECT *, matched / total AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY matched / total DESC, matched DESC, total DESC, first_word, c DESC) AS r FROM ok) WHERE r = 1)
SELECT doc_id, license, matched, total, first_word FROM best x WHERE NOT EXISTS (
  SELECT 1 FROM sib JOIN best o ON o.license = sib.sibling WHERE sib.license = x.license AND o.doc_id = x.doc_id AND o.share > x.share
    AND abs(o.first_word - x.first_word) < greatest(o.c, x.c) * 1.25)
"""
