"""Quality rules with adaptive thresholds (native DataFrame code only).

Per document a few counts are taken; per language and source every ratio gets a
mergeable quantile sketch, and a document goes if a ratio lies beyond the fence
that its own group's quantiles give.  The sketch is a histogram over integer
buckets that keep ten leading bits (relative error below 1/512), so sketches
merge by adding counts: Spark combines them map-side, a hot source is some
thousand rows after the combine, and a group with too few documents takes the
sum of its language's sketches, then that of all.

The upper fence is the 90 % quantile and three times its distance from the
median, or a quarter of the quantile if that is more.  Symbols, repeated lines and repeated words are zero in most documents,
so there the sketch's part above zero counts too: its 90 % quantile and its
distance from that part's median, at most the ratio's ceiling (``RATIOS``: where a
part above zero is mostly junk, its quantiles alone would let the junk stay).  The
larger of both holds, and a tenth of a per cent against rounding.  Short words
have a lower fence, the median less five times its distance from the 90 % quantile.

Null or empty text: no words, so ``base_failed``.  Very long texts are judged
whole.  Null ``lang`` or ``source``
are groups of their own.  Repeated rows are judged (and counted) each for
itself.  An empty table gives an empty table.  Extra columns are passed through
by ``filter_documents``; names starting with ``_q_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, maybe_broadcast, saved, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PCT = 30
MIN_DOCS = 100  # documents that a group's own sketch needs
SPREADS = 3  # upper fence: 90 % quantile + SPREADS * (90 % quantile - median)
LEAST = 4  # that distance counts as a quarter of the 90 % quantile at least, where most documents are alike
LOWER_SPREADS = 5  # lower fence: median - LOWER_SPREADS * (90 % quantile - median)
SLACK = 10  # in 1/10,000
MAX_BROADCAST_GROUPS = 100_000
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# ratio in 1/10,000: numerator, denominator, ceiling of the part above zero (0: not used)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 500),
    "upper": ("_q_upper", "word_chars", 0),
    "dup_lines": ("n_dup_lines", "_q_lines", 5000),
    "repeats": ("n_repeat_words", "n_words", 2500),
    "word_length": ("word_chars", "n_words", 0),
}


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # (hash, position) in order: equal windows are neighbours
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def spans(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])),
            )
            at = F.array_sort(F.transform(again, lambda x: x["p"]))
            return let(
                at,
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, spans))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts of each whole text (null: no words)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n"), _repeat_words(words).alias("r"))

    def lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))

    split_words = F.array_remove(F.split(t, SPACES), "")
    with_word = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    no_space = F.translate(t, " \t\n\x0b\f\r", "")
    out = docs.withColumns({
        "_q_w": let(split_words, counts),
        "_q_l": let(with_word, lines),
        "word_chars": F.length(no_space).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
        "_q_upper": (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long"),
    })
    return out.withColumns({
        "n_words": F.col("_q_w.n"),
        "n_repeat_words": F.col("_q_w.r"),
        "_q_lines": F.col("_q_l.n"),
        "n_dup_lines": F.col("_q_l.n") - F.col("_q_l.d"),
    }).drop("_q_w", "_q_l")


def _ratio(metric: str) -> Column:
    num, den, _ = RATIOS[metric]
    return F.coalesce(F.expr(f"(10000 * {num}) div nullif({den}, 0)"), F.lit(0)).cast("long")


def bucket(v: Column) -> Column:
    """Integer with all but its ten leading bits cleared."""
    shift = F.greatest(F.length(F.bin(v)) - 10, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch per group and metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(_ratio(m)).alias("bucket")) for m in RATIOS])
    return (
        counted.select("lang", "source", F.explode(cells).alias("c"))
        .groupBy("lang", "source", F.col("c.metric").alias("metric"), F.col("c.bucket").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, lo_*, hi_* per metric) from the merged sketches."""
    # level 0: language and source, 1: language, 2: all
    levels = sketch.groupingSets(
        [
            [F.col("lang"), F.col("source"), F.col("metric"), F.col("bucket")],
            [F.col("lang"), F.col("metric"), F.col("bucket")],
            [F.col("metric"), F.col("bucket")],
        ],
        "lang", "source", "metric", "bucket",
    ).agg(
        F.sum("n").alias("n"),
        (F.grouping("lang") + F.grouping("source")).alias("level"),
    )
    cell = Window.partitionBy("level", "lang", "source", "metric")
    ranked = levels.withColumns({
        "upto": F.sum("n").over(cell.orderBy("bucket")),
        "total": F.sum("n").over(cell),
        "zero": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(cell),
    })
    at = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("total"), F.col("bucket")))
    above = lambda p: F.min(F.when(
        (F.col("bucket") > 0) & (100 * (F.col("upto") - F.col("zero")) >= p * (F.col("total") - F.col("zero"))), F.col("bucket")))
    fences = ranked.groupBy("level", "lang", "source", "metric").agg(
        F.first("total").alias("total"), at(50).alias("q50"), at(90).alias("q90"), above(50).alias("z50"), above(90).alias("z90")
    )
    ceiling = F.create_map(*[x for m, (_, _, c) in RATIOS.items() for x in (F.lit(m), F.lit(c))])[F.col("metric")]
    part = F.least(F.coalesce(2 * F.col("z90") - F.col("z50"), F.lit(0)), ceiling)
    fences = fences.withColumns({
        "hi": F.greatest(F.col("q90") + F.greatest(SPREADS * (F.col("q90") - F.col("q50")), F.expr(f"q90 div {LEAST}")), part) + SLACK,
        "lo": F.when(F.col("metric") == "word_length", F.col("q50") - LOWER_SPREADS * (F.col("q90") - F.col("q50")) - SLACK).otherwise(-1),
    })
    wide = fences.groupBy("level", "lang", "source").agg(
        F.first("total").alias("total"),
        *[F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"_q_{x}_{m}") for m in RATIOS for x in ("lo", "hi")],
    )
    limits = [f"_q_{x}_{m}" for m in RATIOS for x in ("lo", "hi")]
    box = F.struct(*limits)
    own = wide.filter("level = 0").select("lang", "source", F.col("total").alias("n0"), box.alias("b0"))
    lang = wide.filter("level = 1").select(F.col("lang").alias("lang1"), F.col("total").alias("n1"), box.alias("b1"))
    every = wide.filter("level = 2").select(box).scalar()  # one row
    return (
        own.join(lang, own["lang"].eqNullSafe(lang["lang1"]), "left")
        .withColumn("b", F.when(F.col("n0") >= MIN_DOCS, F.col("b0")).when(F.col("n1") >= MIN_DOCS, F.col("b1")).otherwise(every))
        .select(F.col("lang").alias("_q_lang"), F.col("source").alias("_q_source"), "b.*")
    )


def judge(counted: DataFrame) -> DataFrame:
    """``counted`` (a saved table with the counts) joined with its groups' thresholds."""
    limits = maybe_broadcast(saved(thresholds(sketches(counted)), "rule-limits"), MAX_BROADCAST_GROUPS)
    # in buckets, as the fences are: a value equal to its group's quantile isn't beyond it
    beyond = [(bucket(_ratio(m)) > F.col(f"_q_hi_{m}")) | (bucket(_ratio(m)) < F.col(f"_q_lo_{m}")) for m in RATIOS]
    any_beyond = beyond[0]
    for b in beyond[1:]:
        any_beyond = any_beyond | b
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    joined = counted.join(
        limits, counted["lang"].eqNullSafe(limits["_q_lang"]) & counted["source"].eqNullSafe(limits["_q_source"]), "left"
    )
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(any_beyond, F.lit(False)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document (doc_id, text, lang, source read)."""
    counted = saved(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"), "rule-counts")
    return judge(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all columns of ``docs``."""
    columns = docs.columns
    packed = docs.select(F.struct(*[docs[c] for c in columns]).alias("_q_row"), "text", "lang", "source")
    counted = saved(with_counts(packed).drop("text"), "rule-docs")
    return judge(counted).filter("kept").select("_q_row.*").select(*columns)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_CASES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, '{m}' AS metric, {s} AS ceiling, coalesce((10000 * {n}) // nullif({d}, 0), 0) AS v FROM counts"
    for m, (n, d, s) in {m: (n.replace("_q_", "n_"), d.replace("_q_", "n_"), s) for m, (n, d, s) in RATIOS.items()}.items()
)
OP3_SQL = f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM t WHERE len(w) >= {WINDOW}),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS x FROM pos),
again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - p, {WINDOW}))) AS n FROM
        (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nxt FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM
       (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT t.doc_id, lang, source, len(w) AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
    coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.d, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)),
vals AS ({_CASES}),
b AS (SELECT *, greatest(length(bin(v)) - 10, 0) AS s FROM vals),
cells AS (SELECT lang, source, metric, ceiling, (v >> s) << s AS bucket, count(*) AS n FROM b GROUP BY ALL),
lv AS (SELECT 0 AS level, lang, source, metric, ceiling, bucket, sum(n) AS n FROM cells GROUP BY ALL
       UNION ALL SELECT 1, lang, NULL, metric, ceiling, bucket, sum(n) FROM cells GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, metric, ceiling, bucket, sum(n) FROM cells GROUP BY ALL),
rk AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
              sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM lv),
-- the part above zero has sums of its own
nz AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto,
              sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM lv WHERE bucket > 0),
z AS (SELECT level, lang, source, metric, min(bucket) FILTER (100 * upto >= 50 * total) AS z50,
        min(bucket) FILTER (100 * upto >= 90 * total) AS z90 FROM nz GROUP BY ALL),
q AS (SELECT level, lang, source, metric, ceiling, max(total) AS total, min(bucket) FILTER (100 * upto >= 50 * total) AS q50,
        min(bucket) FILTER (100 * upto >= 90 * total) AS q90 FROM rk GROUP BY ALL),
f AS (SELECT q.*, greatest(q90 + greatest({SPREADS} * (q90 - q50), q90 // {LEAST}), least(coalesce(z90 + (z90 - z50), 0), ceiling)) + {SLACK} AS hi,
        CASE WHEN q.metric = 'word_length' THEN q50 - {LOWER_SPREADS} * (q90 - q50) - {SLACK} ELSE -1 END AS lo
      FROM q LEFT JOIN z ON z.level = q.level AND z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source AND z.metric = q.metric),
judged AS (SELECT v.doc_id, bool_or(
        ((v.v >> v.s) << v.s) > CASE WHEN f0.total >= {MIN_DOCS} THEN f0.hi WHEN f1.total >= {MIN_DOCS} THEN f1.hi ELSE f2.hi END
     OR ((v.v >> v.s) << v.s) < CASE WHEN f0.total >= {MIN_DOCS} THEN f0.lo WHEN f1.total >= {MIN_DOCS} THEN f1.lo ELSE f2.lo END) AS beyond
    FROM b v
    JOIN f f0 ON f0.level = 0 AND f0.lang IS NOT DISTINCT FROM v.lang AND f0.source IS NOT DISTINCT FROM v.source AND f0.metric = v.metric
    JOIN f f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM v.lang AND f1.metric = v.metric
    JOIN f f2 ON f2.level = 2 AND f2.metric = v.metric GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words OR beyond) AS kept
FROM counts JOIN judged USING (doc_id)
"""
