"""Collocations from a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
pieces into words ``[^\\x20\\x09]+``.  The longest grams, three words, are the
edges of a graph whose nodes are pairs of words: ``a b c`` leads from ``a b`` to
``b c``.  Only edges are counted in the texts; every place of a piece gives the
edge that begins there, the last two places short ones (``a b -``, ``a - -``).
A pair's count is the flow out of its node plus the short edges there, a word's
count the flow of the nodes that begin with it plus its own short edges.

Edges of at least ``min_count`` make the frequent graph.  Its unary paths (one
edge out of a node, one into the next) are compacted by pointer doubling into
rows of at most ``SEGMENT`` nodes; a cycle is opened at its least node.  Inside
a path an edge reads the counts of both its pairs, and a pair its longer
phrases, from its neighbours in the row; only branching edges are joined.

A phrase of two or three words is a candidate with count a >= ``min_count``.  A
cut into two parts of counts l and r scores ``floor(10^6 a^2 / (l r))``; the
lowest-scoring cut counts (ties: the first).  A pair inside a candidate triple
with ``100 f(triple) >= covered * a`` is dropped.  The arithmetic is in decimals
of 38 digits, exact up to counts of 10^16.

Defined results: null texts: no words; null languages: ``und``; empty texts and
empty tables: no phrase; very long texts: whole; repeated rows count each; equal
scores: the larger count first, then the phrase's UTF-8 bytes; other columns
aren't read.  A word or pair that a third of all places hold is counted in each
task before the shuffle: its triples come to a group once for each block of text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

BLOCK = 8 << 20  # bytes of text that a task counts at a time
BUCKET = 16 << 20  # bytes of text whose triples one group sums up, on average
PACK = 1 << 16  # triples in a row
SEGMENT = 1000  # nodes of a path that are kept in one row
_TABLE = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)  # A-Z to a-z, tab to space, the ends of pieces to line feeds; no length changes


def _summed(triples: np.ndarray, n: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``triples`` (word numbers below ``base``) in order, and the sums of their counts."""
    pairs = triples[:, 0].astype(np.int64) * base + triples[:, 1]
    if base >= 1 << 21:  # three numbers don't fit into one
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * base + triples[:, 2]
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else order
    return triples[order[begins]], np.add.reduceat(n[order], begins) if len(keys) else n


def _count(texts: list[bytes]):
    """Words of some texts, their triples as word numbers from 1 (0: past the piece's end) and the counts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ") + b" \n "
    coded = pc.split_pattern(pa.array([raw], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
    names = coded.dictionary
    at = coded.indices.to_numpy()
    at = at[at != names.index("").as_py()]
    at = np.r_[np.where(at == names.index("\n").as_py(), 0, at + 1), 0, 0]
    triples = np.stack([at[:-2], at[1:-1], at[2:]], axis=1)
    triples = triples[triples[:, 0] > 0]
    triples[triples[:, 1] == 0, 2] = 0
    return names, *_summed(triples, np.ones(len(triples), np.int64), len(names) + 1)


def _packed(names, triples: np.ndarray, n: np.ndarray, buckets: int):
    """(bucket, words, triples, counts) in rows of at most PACK triples; a node's triples have one bucket."""
    hashed = np.array([0] + [zlib.crc32(w.encode()) for w in names.to_pylist()], np.uint64)
    node = hashed[triples[:, 0]] * np.uint64(0x9E3779B97F4A7C15) + hashed[triples[:, 1]]
    node = (node ^ (node >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((node >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True]) if len(order) else [0]
    for s, e in zip(edge[:-1], edge[1:]):
        for k in range(s, e, PACK):
            part = order[k : min(k + PACK, e)]
            used, local = np.unique(np.r_[0, triples[part].ravel()], return_inverse=True)
            yield int(bucket[part[0]]), names.take(used[1:] - 1), local[1:].astype(np.int32), n[part]


def edges(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, w1, w2, w3, n): triples of at least ``min_count``, pairs of at least that (w3 null), and parts of the
    words' counts (w2 null).

    Each task counts the triples of some megabytes of text; the counts of a node
    (its first two words) are summed up in one group, among some 15 MB of text's.
    """
    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.length("text") > 0)
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))

    def count(batches):
        import pyarrow as pa

        def blocks():
            held, size = {}, 0
            for b in batches:
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    raw = text.encode()
                    held.setdefault(lang, []).append(raw)
                    size += len(raw)
                    if size >= BLOCK:
                        yield held
                        held, size = {}, 0
            yield held

        lists = lambda v, t: pa.array([v], pa.list_(t))
        for held in blocks():
            for lang in list(held):
                for bucket, used, local, n in _packed(*_count(held.pop(lang)), buckets):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([bucket], pa.int64()), lists(used.cast(pa.string()), pa.string()), lists(local, pa.int32()), lists(n, pa.int64())],
                        ["lang", "bucket", "words", "triples", "n"])
            pa.default_memory_pool().release_unused()

    def merge(key, group):
        import pyarrow as pa

        col = lambda c: group.column(c).combine_chunks()
        lists, flat = col("words"), col("triples")
        coded = lists.flatten().dictionary_encode()
        names, number = coded.dictionary, np.r_[0, coded.indices.to_numpy() + 1]
        begin = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        local = flat.flatten().to_numpy()
        shift = np.repeat(begin, np.diff(flat.offsets.to_numpy()))
        triples = number[np.where(local > 0, local + shift, 0)].reshape(-1, 3)
        triples, n = _summed(triples, col("n").flatten().to_numpy(), len(names) + 1)
        new = np.diff(triples, axis=0, prepend=-1) != 0
        parts = [(triples[often := (triples[:, 2] > 0) & (n >= min_count)], n[often])]
        for width in (2, 1):  # the flow of nodes and words, with the short edges at the ends of pieces
            at = np.flatnonzero(new[:, :width].any(axis=1))
            grams, sums = triples[at] * (np.arange(3) < width), np.add.reduceat(n, at) if len(at) else n
            use = (grams[:, 1] > 0) & (sums >= min_count) if width == 2 else np.ones(len(at), bool)
            parts.append((grams[use], sums[use]))
        grams, sums = (np.concatenate(x) for x in zip(*parts))
        words = [names.take(pa.array(w - 1, mask=w == 0)) for w in grams.T]
        return pa.table([pa.array([key[0].as_py()] * len(sums), pa.string()), *words, pa.array(sums, pa.int64())], names=["lang", "w1", "w2", "w3", "n"])

    packs = given.mapInArrow(count, "lang string, bucket long, words array<string>, triples array<int>, n array<long>")
    return packs.groupBy("lang", "bucket").applyInArrow(merge, "lang string, w1 string, w2 string, w3 string, n long")


def _positions(links: DataFrame) -> DataFrame:
    """(lang, node, head, d) of every node with a link into it, from (lang, node, prior); nodes on a cycle count
    from its least node, which is left out."""
    begin = links.select("lang", "node", F.col("prior").alias("head"), F.lit(1).cast("long").alias("d"), F.least("node", "prior").alias("least"))
    open_, done = saved(begin, "pointers"), []
    state = None
    while True:
        step = open_.select("lang", F.col("node").alias("head"), F.col("head").alias("h2"), F.col("d").alias("d2"), F.col("least").alias("l2"))
        got = saved(
            open_.join(step, ["lang", "head"], "left").select(
                "lang", "node", F.coalesce("h2", "head").alias("head"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
                F.least("least", "l2").alias("least"), F.col("h2").isNull().alias("ends")), "pointers")
        now = got.agg(F.count_if("ends"), F.count_if(~F.col("ends")), F.expr("bit_xor(xxhash64(lang, node, least))")).first()
        # a node that ends here has its head, but those that point at it still need it
        if now[1] == 0 or now == state:
            break
        open_, state = got.drop("ends"), now
    finished = got.filter("ends").select("lang", "node", "head", "d")
    if now[1]:  # cycles: open each at its least node, which then has no prior
        round_ = got.filter("not ends").select("lang", "node", "least")
        rest = links.join(round_, ["lang", "node"]).filter("node <> least").select("lang", "node", "prior")
        finished = finished.union(_positions(rest))
    return finished


def graph(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of ``arcs`` (lang, prior, node, n) and ``nodes`` (lang, node, n), compacted: (paths, branches).

    ``paths``: lang, head, part and ``nodes``, an array of (d, node, n, n_in) in
    order: pair, its count and that of the edge from the node before (null for
    a path's first).  Parts overlap by one node.  ``branches``: lang, node,
    next, n of the edges between paths.
    """
    single = lambda c: arcs.groupBy("lang", c).count().filter("count = 1").drop("count")
    unary = arcs.filter("prior <> node").join(single("prior"), ["lang", "prior"]).join(single("node"), ["lang", "node"])
    links = saved(unary.select("lang", "node", "prior", "n"), "links")
    placed = saved(_positions(links.drop("n")), "placed")
    inside = links.join(placed, ["lang", "node"]).select("lang", "node", "head", "d", F.col("n").alias("n_in"))
    inside = saved(inside, "inside")
    rows = nodes.join(inside, ["lang", "node"], "left").select(
        "lang", F.coalesce("head", "node").alias("head"), F.struct(F.coalesce("d", F.lit(0).cast("long")).alias("d"), "node", "n", "n_in").alias("v"))
    # a part's first node is also the last of the part before, so that each edge lies in one part
    part = (F.col("v.d") / SEGMENT).cast("long")
    shared = (F.col("v.d") % SEGMENT == 0) & (F.col("v.d") > 0)
    rows = rows.withColumn("part", F.explode(F.when(shared, F.array(part, part - 1)).otherwise(F.array(part))))
    paths = rows.groupBy("lang", "head", "part").agg(F.sort_array(F.collect_list("v")).alias("nodes"))
    taken = inside.select("lang", "node", F.lit(True).alias("linked"))
    branches = arcs.join(taken, ["lang", "node"], "left").filter("linked is null").select("lang", F.col("prior").alias("node"), F.col("node").alias("next"), "n")
    return paths, branches


def collocations(docs: DataFrame, min_count: int = 10, covered: int = 50, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best ``top`` phrases (None: all)."""
    counts = saved(edges(docs, min_count), "counts")
    word_table = saved(counts.filter("w2 is null").groupBy("lang", "w1").agg(F.sum("n").alias("n")), "words")
    total = word_table.groupBy("lang").agg(F.sum("n").alias("n_all"))
    pair_of = lambda a, b: F.concat_ws(" ", a, b)
    arcs = counts.filter("w3 is not null").select("lang", pair_of("w1", "w2").alias("prior"), pair_of("w2", "w3").alias("node"), "n")
    nodes = counts.filter("w2 is not null and w3 is null").select("lang", pair_of("w1", "w2").alias("node"), "n")
    paths, branches = graph(arcs, nodes)
    paths = saved(paths, "paths")

    # triples inside paths: the neighbours hold the counts of their pairs
    near = paths.select("lang", F.explode(F.expr(
        "transform(sequence(1, size(nodes)), i -> struct(nodes[i - 1] as v, get(nodes, i) as nxt, get(nodes, i - 2) as prv))")).alias("e"))
    near = saved(near.select("lang", "e.*"), "near")
    last = lambda c: F.substring_index(c, " ", -1)
    first = lambda c: F.substring_index(c, " ", 1)
    triple = near.filter("nxt.n_in is not null").select(
        "lang", F.concat_ws(" ", "v.node", last("nxt.node")).alias("phrase"), first("v.node").alias("one"), last("nxt.node").alias("end"),
        F.col("nxt.n_in").alias("a"), F.col("v.n").alias("head_n"), F.col("nxt.n").alias("tail_n"))
    count = lambda c, name: near.select("lang", F.col("v.node").alias(c), F.col("v.n").alias(name)).distinct()
    between = branches.join(count("node", "head_n"), ["lang", "node"]).join(count("next", "tail_n"), ["lang", "next"]).select(
        "lang", F.concat_ws(" ", "node", last("next")).alias("phrase"), first("node").alias("one"), last("next").alias("end"),
        F.col("n").alias("a"), "head_n", "tail_n")
    triple = triple.union(between)

    # pairs with the most frequent triple that holds them
    held = near.select("lang", F.col("v.node").alias("phrase"), F.col("v.n").alias("a"), F.greatest("v.n_in", "nxt.n_in").alias("longer"))
    for c in ("node", "next"):
        held = held.union(branches.select("lang", F.col(c), F.lit(None).cast("long"), "n"))
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    free = held.filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    none = F.lit(None).cast("long")
    pair = free.select("lang", "phrase", first("phrase").alias("one"), last("phrase").alias("end"), "a", none.alias("head_n"), none.alias("tail_n"))

    spelled = lambda c, name: word_table.select("lang", F.col("w1").alias(c), F.col("n").alias(name))
    rows = triple.union(pair).join(spelled("one", "one_n"), ["lang", "one"]).join(spelled("end", "end_n"), ["lang", "end"])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    rows = rows.withColumns({"l1": F.col("one_n"), "r1": F.coalesce("tail_n", "end_n"), "l2": F.coalesce("head_n", "one_n"), "r2": F.col("end_n")})
    millions = exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")
    for k in "12":
        product = (exact(f"l{k}") * exact(f"r{k}")).cast("decimal(38,0)")
        rows = rows.withColumn(f"top{k}", millions).withColumn(f"low{k}", product).withColumn(f"s{k}", F.expr(f"top{k} div low{k}"))
    second = F.col("s2") < F.col("s1")
    pick = lambda c: F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))
    scored = rows.select("lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order))  # with ``top``, each task keeps its best before the shuffle
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("n_all").alias("n"), "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
split as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from pieces),
grams as (
  select lang, unnest(w) phrase, 1 size from split
  union all select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 from split
  union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 from split),
f as (select lang, phrase, size, count(*)::hugeint a from grams group by all),
total as (select lang, sum(a) n from f where size = 1 group by lang),
cuts as (
  select c.lang, c.phrase, c.a, c.size, k,
    array_to_string(string_split(c.phrase, ' ')[1:k], ' ') one, array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') rest
  from f c, range(1, 3) t(k) where c.size >= 2 and c.a >= 10 and k < c.size),
scored as (
  select cuts.*, x.a l, y.a r, 1000000 * cuts.a * cuts.a // (x.a * y.a) score
  from cuts join f x on x.lang = cuts.lang and x.phrase = one join f y on y.lang = cuts.lang and y.phrase = rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_pairs as (
  select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) phrase, a
  from f where size = 3 and a >= 10),
longer as (select lang, phrase, max(a) a from inner_pairs group by all),
kept as (
  select c.* from lowest c left join longer g on g.lang = c.lang and g.phrase = c.phrase
  where c.size = 3 or g.a is null or 100 * g.a < 50 * c.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept)
select k.lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, total.n::bigint n, score::bigint score
from ranked k join total on total.lang = k.lang where rank <= 2000
"""
