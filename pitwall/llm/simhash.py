"""SimHash near-duplicates: fingerprints meet at the anchors of a covering code.

A 64-bit fingerprint is cut into blocks of 22, 21 and 21 bits, each embedded in
the binary Golay code of length 23: a perfect code, whose 4,096 words cover all
values within three bits.  If two fingerprints differ in at most three bits, at
least two of the three blocks differ in at most one bit.  So for each pair of
blocks a fingerprint is put at its own anchor (the code word within the covering
radius) in one block, and at every anchor within radius plus threshold that a
value one bit away can have, in the other; once as left, with the replicas in
the first block, and once as right, with those in the second.  Two linked
fingerprints then meet, left against right, at one of 2^24 anchors a pair.

Equal fingerprints are one row from the start, so copies cost nothing.  An
anchor with more than ``HOT_ROWS`` rows is dealt out in blocks of left against
blocks of right.  At an anchor only links that join two parts are written (a
spanning forest), never all pairs.

Null and empty texts have fingerprint zero and are linked like any other.  Null
ids never name a component unless all its ids are null.  Repeated rows give
repeated rows; an empty table gives an empty table; very long texts are hashed
whole.  Ids may be of any type that has an order.  Other columns are not read, and
are passed through by ``one_of_each`` whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .graph import components

BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit, width
PAIRS = ((0, 1), (0, 2), (1, 2))
THRESHOLD = 3
HOT_ROWS = 20_000
SMALL = 256  # pairs of an anchor that are compared all at once
GOLAY = 0xAE3  # generator polynomial of the binary Golay code


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the ``size``-word shingles (repeats included) of a UTF-8 text."""
    from xxhash import xxh64_intdigest as xx

    words = text.lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xx(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    hashes = np.array([xx(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[size - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, _s_text, _s_fp): id, hash of the text and fingerprint (as signed long) of each row."""
    kept = docs.select("doc_id", F.xxhash64("text").alias("_s_text"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_s_b"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = np.array([fingerprint(x, size) for x in b.column("_s_b").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got.view(np.int64))], ["doc_id", "_s_text", "_s_fp"])

    schema = kept.drop("_s_b").withColumn("_s_fp", F.lit(0).cast("long")).schema
    return kept.mapInArrow(run, schema)


def _syndrome_tables():
    def rest(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GOLAY << (k - 11)
        return x

    single = [rest(1 << i) for i in range(23)]
    table = lambda bits: np.array([
        int(np.bitwise_xor.reduce([single[b] for i, b in enumerate(bits) if x >> i & 1] or [0])) for x in range(1 << len(bits))
    ], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return table(range(12)), table(range(12, 23)), errors


class Anchors:
    """Nearest code word, and the code words near enough for a value one bit away."""

    def __init__(self):
        self.low, self.high, self.errors = _syndrome_tables()

    def home(self, y: np.ndarray) -> np.ndarray:
        return y ^ self.errors[self.low[y & 4095] ^ self.high[y >> 12]]

    def near(self, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, anchor) for each anchor of ``y`` or of a value one bit away."""
        flips = np.concatenate([[0], 1 << np.arange(width)])
        words = np.sort(self.home(y[:, None] ^ flips[None, :]), axis=1)
        new = np.ones(words.shape, dtype=bool)
        new[:, 1:] = words[:, 1:] != words[:, :-1]
        return np.nonzero(new)[0], words[new]


def place(fps: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, role, fingerprint) rows: role 0 is left, 1 is right."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in BLOCKS]
    home = [anchors.home(p) for p in parts]
    near = [anchors.near(p, width) for p, (_, width) in zip(parts, BLOCKS)]
    keys, roles, values = [], [], []
    for k, (i, j) in enumerate(PAIRS):
        for role, (r, first, second) in enumerate((
            (near[i][0], near[i][1], home[j][near[i][0]]),
            (near[j][0], home[i][near[j][0]], near[j][1]),
        )):
            keys.append(k << 46 | first << 23 | second)
            roles.append(np.full(len(r), role, dtype=np.int32))
            values.append(fps[r])
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(values)


def _forest(values: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct ``values``."""
    out, left = [], values
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            linked = np.bitwise_count(left ^ x) <= threshold
            if linked.any():
                queue.extend(left[linked])
                out.extend((x, y) for y in left[linked])
                left = left[~linked]
    return out


def links(group: np.ndarray, role: np.ndarray, fps: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Links (n x 2) within groups; rows are sorted by group, left before right."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    rights = np.add.reduceat(role, starts)
    lefts = np.diff(np.r_[starts, len(group)]) - rights
    todo = (lefts > 0) & (rights > 0)
    small = todo & (lefts * rights <= SMALL)
    out = []
    s, nl, nr = starts[small], lefts[small].astype(np.int64), rights[small].astype(np.int64)
    for k in range(0, len(s), 20_000):
        a, l, r = s[k : k + 20_000], nl[k : k + 20_000], nr[k : k + 20_000]
        n = l * r
        g = np.repeat(np.arange(len(a)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, y = fps[a[g] + at // r[g]], fps[a[g] + l[g] + at % r[g]]
        ok = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        out.append(np.stack([x[ok], y[ok]], axis=1))
    for i in np.flatnonzero(todo & ~small):
        found = _forest(np.unique(fps[starts[i] : starts[i] + lefts[i] + rights[i]]), threshold)
        if found:
            out.append(np.array(found, dtype=np.uint64))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.uint64)


def edges(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(u, v) links among the distinct fingerprints of column ``_s_fp``."""

    def replicate(batches):
        import pyarrow as pa

        anchors = Anchors()
        for b in batches:
            key, role, fp = place(b.column(0).to_numpy().view(np.uint64), anchors)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp.view(np.int64))], ["key", "role", "fp"])

    rows = distinct.select("_s_fp").mapInArrow(replicate, "key long, role int, fp long")
    hot = rows.groupBy("key").count().filter(F.col("count") > HOT_ROWS).select("key", F.expr("count div %d + 1" % HOT_ROWS).alias("n"))
    dealt = rows.join(hot, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    dealt = dealt.select("key", "role", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    cell = F.when(F.col("role") == 0, F.struct("own", "other")).otherwise(F.struct(F.col("other").alias("own"), F.col("own").alias("other")))
    dealt = dealt.select("key", cell.alias("cell"), "role", "fp").select("key", "cell.own", "cell.other", "role", "fp")
    ordered = dealt.repartition("key", "own", "other").sortWithinPartitions("key", "own", "other", "role")

    def compare(batches):
        import pyarrow as pa

        def result(key, a, b, role, fp):
            new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            got = links(np.cumsum(new), role, fp.view(np.uint64), threshold)
            return pa.RecordBatch.from_arrays([pa.array(got[:, i].copy().view(np.int64)) for i in (0, 1)], ["u", "v"])

        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= 250_000:
                cols = [np.concatenate(c) for c in zip(*held)]
                last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield result(*[c[:cut] for c in cols])
                held, rows = [[c[cut:] for c in cols]], rows - cut
        if rows:
            yield result(*[np.concatenate(c) for c in zip(*held)])

    return ordered.mapInArrow(compare, "u long, v long")


def classes(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(_s_fp, _s_first, ...): each distinct fingerprint with the first row (by id) of its component."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_s_text")
    distinct = saved(prints.groupBy("_s_fp").agg(F.min(key).alias("_s_first")), "fingerprints")
    roots = components(edges(distinct, threshold)).toDF("_s_fp", "_s_root")
    rooted = distinct.join(roots, "_s_fp", "left").withColumn("_s_root", F.coalesce("_s_root", "_s_fp"))
    first = rooted.groupBy("_s_root").agg(F.min("_s_first").alias("_s_first"))
    return rooted.select("_s_fp", "_s_root").join(first, "_s_root")


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text)."""
    prints = saved(fingerprints(docs, size), "prints")
    of = classes(prints, threshold).select("_s_fp", F.col("_s_first.doc_id").alias("component_id"))
    return prints.join(of, "_s_fp").select("doc_id", F.lower(F.lpad(F.hex("_s_fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: that of the least id (ties: least text hash)."""
    prints = saved(fingerprints(docs.select("doc_id", "text"), size), "prints")
    first = classes(prints, threshold).select("_s_first.*").distinct().toDF("_s_none", "_s_id", "_s_th")
    marked = docs.select("doc_id", F.xxhash64("text").alias("_s_text"), F.struct(*[docs[c] for c in docs.columns]).alias("_s_row"))
    kept = marked.join(first, marked["doc_id"].eqNullSafe(first["_s_id"]) & (marked["_s_text"] == first["_s_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_s_text"]).select("_s_row.*")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
