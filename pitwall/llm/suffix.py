"""Removal of repeated byte strings, by suffix sorting of what can be repeated.

Every byte covered by a 100-byte string that also starts earlier (smaller id, or
same document, earlier start) goes.

1. *Anchors.*  Of the 69 places in a 100-byte string where 32 bytes begin, the
   one with the least hash is its anchor.  Equal strings have equal anchors, so
   only places that share an anchor's hash can be equal; about one byte in
   thirty-five is an anchor.  An anchor goes into the shuffle as its hash, a hash
   of its context (the up to 168 bytes that strings with this anchor can cover)
   and its place.  Within a task, equal contexts after the first are marked at
   once and only the first goes on, so a passage or copy that a third of all
   documents hold is one row a task.
2. Sorted by hash and context, equal contexts after the first are marked.  First
   contexts go on only where their anchor has another context.
3. *Suffix arrays.*  Those contexts' texts are fetched and dealt out by anchor.
   Each block of whole anchors gets a suffix array by two-stage sorting: suffixes
   smaller than their successors are sorted directly (to the depth that matters),
   the others are induced by one scan over the buckets of first bytes; then the
   common prefixes of neighbours are computed, and runs of at least 100 bytes are
   equal strings, of which all but the first are marked.
   Equal strings begin equally far before their anchor, so an anchor with more
   than ``SPREAD`` contexts is dealt out, and one with more text than a block is
   sorted, in slices of a few such distances.  Anchors with more than ``HOT``
   contexts aren't sorted in one task: their strings are grouped by hash, with
   minima combined map-side.
4. The marks of each document are united and cut out of its text.

Null texts count as empty ones.  Documents with equal ids are ordered by the
hash of their text, null ids come last; an empty table gives an empty table.
Texts shorter than 100 bytes are never cut; very long ones are compared whole.
Ids may be of any type that has an order.  Other columns are not read, and are
passed through by ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import saved, table

LENGTH = 100
K = 32
SPAN = LENGTH - K  # places of an anchor in a string: SPAN + 1
HOT = 100_000
SPREAD = 1_000
SLICE = 8  # distances of an anchor that are sorted together, if it has much text
BLOCK = 1 << 20  # bytes that are looked at or sorted at a time
MARK = -(1 << 63)  # sign bit of a packed (from, to): a mark, not a context
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
PAD = 256


# ------------------------------------------------------------------ anchors
def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each place as one number (a view)."""
    return np.ndarray((len(data) - 7,), dtype=f"{order}u8", buffer=data, strides=(1,))


def _hash32(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of the 32 bytes from each of ``n`` places."""
    h = w[:n] * ODD[0]
    for k in (1, 2, 3):
        h ^= h >> np.uint64(32)
        h += w[8 * k : 8 * k + n]
        h *= ODD[k]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors of all 100-byte strings within documents; ``data`` is padded."""
    total = int(ends[-1]) if len(ends) else 0
    long = ends - starts >= LENGTH
    edge = np.zeros(total + 2, dtype=np.int8)
    edge[starts[long]] += 1
    edge[ends[long] - LENGTH + 1] -= 1
    valid = np.cumsum(edge[:total], dtype=np.int8).view(bool)
    step, mask = 1 << 16, np.uint64((1 << 18) - 1)
    at, hashes = [], []
    w = _words(data)
    for c in range(0, total, step):
        ok = valid[c : c + step]
        if not ok.any():
            continue
        h = _hash32(w[c:], len(ok) + SPAN)
        m = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        for s in (1, 2, 4, 8, 16, 32):
            m = np.minimum(m[:-s], m[s:])
        m = np.minimum(m[: -(SPAN - 63)], m[SPAN - 63 :])  # of 64 and 64 to 69 places
        p = (m[ok] & mask).astype(np.int64)
        p = p[np.r_[True, p[1:] != p[:-1]]]
        at.append(p + c)
        hashes.append(h[p])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(at), return_index=True)
    return places, np.concatenate(hashes)[first]


def _context_hash(w: np.ndarray, a: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = ((e - a) << 20 | at - a).astype(np.uint64) * ODD[1]
    for j in range(0, SPAN + LENGTH, 8):
        left = e - a - j
        keep = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1))
        c = (c ^ (w[np.minimum(a + j, len(w) - 1)] & keep)) * ODD[j // 8 % 4]
        c ^= c >> np.uint64(31)
    return c


def merged(rid: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [a, b) of each document, united."""
    if not len(rid):
        return rid, a, b
    o = np.lexsort((a, rid))
    rid, a, b = rid[o], a[o], b[o]
    doc = np.cumsum(np.r_[0, rid[1:] != rid[:-1]]) << 33
    reach = np.maximum.accumulate(b + doc)
    new = np.r_[True, (a + doc)[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
    return rid[new], a[new], (reach - doc)[last]


def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _pack_context(a: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Begin, length and place of the anchor within it, of a context."""
    return _pack(a, (e - a) << 8 | at - a)


def _as_mark(packed: np.ndarray) -> np.ndarray:
    a = packed >> 32
    return _pack(a, a + (packed >> 8 & 0xFF)) | MARK


def _blocks(col, rid: np.ndarray):
    """(bytes, starts, ends, ids) of consecutive documents of about BLOCK bytes, from an Arrow column."""
    offsets = np.frombuffer(col.buffers()[1], np.int64 if str(col.type).startswith("large") else np.int32)
    offsets = offsets[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(rid):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        part = np.zeros(offsets[j] - offsets[i] + PAD, np.uint8)
        part[:-PAD] = data[offsets[i] : offsets[j]]
        at = offsets[i : j + 1] - offsets[i]
        yield part, at[:-1], at[1:], rid[i:j]
        i = j


def _anchor_rows(data, starts, ends, ids):
    """(h, c, rid, packed) rows of a block: first contexts, and marks of later equal ones."""
    at, h = anchors(data, starts, ends)
    doc = np.searchsorted(starts, at, side="right") - 1
    a, e = np.maximum(at - SPAN, starts[doc]), np.minimum(at + LENGTH, ends[doc])
    c = _context_hash(_words(data), a, e, at).view(np.int64)
    a, e, at, rid, h = a - starts[doc], e - starts[doc], at - starts[doc], ids[doc], h.view(np.int64)
    o = np.lexsort((a, rid, c, h))
    later = np.zeros(len(o), dtype=bool)
    later[1:] = (h[o][1:] == h[o][:-1]) & (c[o][1:] == c[o][:-1])
    first, later = o[~later], o[later]
    mr, ma, mb = merged(rid[later], a[later], e[later])
    return (
        np.r_[h[first], mr],
        np.r_[c[first], np.zeros(len(mr), np.int64)],
        np.r_[rid[first], mr],
        np.r_[_pack_context(a[first], e[first], at[first]), _pack(ma, mb) | MARK],
    )


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(h, c, rid, packed) of ``docs`` (rid, bytes)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for block in _blocks(batch.column("bytes"), batch.column("rid").to_numpy()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _anchor_rows(*block)], ["h", "c", "rid", "packed"])

    return docs.select("rid", "bytes").mapInArrow(run, "h long, c long, rid long, packed long")


def repeats(rows: DataFrame) -> DataFrame:
    """(h, rid, packed): marks of later equal contexts, and first contexts of anchors with more than one."""
    ordered = rows.repartition("h").sortWithinPartitions("h", "c", "rid", "packed")

    def run(batches):
        import pyarrow as pa

        last = None  # the context that is open: h, c, rid, packed, and whether it's known to go on
        for batch in batches:
            h, c, rid, packed = (x.to_numpy() for x in batch.columns)
            is_mark = packed < 0
            out = [(h[is_mark], rid[is_mark], packed[is_mark])]
            h, c, rid, packed = (x[~is_mark] for x in (h, c, rid, packed))
            if len(h):
                if last is not None:
                    h, c, rid, packed = (np.r_[x, y] for x, y in zip(last[:4], (h, c, rid, packed)))
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
                out.append((h[~new], rid[~new], _as_mark(packed[~new])))
                h, c, rid, packed = (x[new] for x in (h, c, rid, packed))
                same = h[1:] == h[:-1]
                more = np.r_[same, False] | np.r_[last is not None and last[4], same]
                done = more.copy()
                done[-1] = False  # it stays open
                out.append((h[done], rid[done], packed[done]))
                last = (h[-1], c[-1], rid[-1], packed[-1], bool(more[-1]))
            cols = [np.concatenate(x) for x in zip(*out)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "rid", "packed"])
        if last is not None and last[4]:
            yield pa.RecordBatch.from_arrays([pa.array(np.array([x])) for x in (last[0], last[2], last[3])], ["h", "rid", "packed"])

    return ordered.mapInArrow(run, "h long, rid long, packed long")


# ------------------------------------------------------------ suffix arrays
def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The wanted suffixes of ``text`` (padded), in order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text) - PAD
    t = text[: n + 1].astype(np.int16)
    t[n] = -1  # the empty suffix is least
    change = np.flatnonzero(t[:-1] != t[1:])
    run_end = change[np.searchsorted(change, np.arange(n))]
    smaller = t[run_end + 1] > t[run_end]  # than its successor: sorted directly
    need = np.zeros(n + 1, dtype=bool)
    need[wanted] = True
    chain = wanted[~smaller[wanted]]
    while len(chain):  # what the others are induced from
        chain = chain + 1
        chain = chain[~need[chain]]
        need[chain] = True
        chain = chain[chain < n]
        chain = chain[~smaller[chain]]
    need[n] = False

    # first stage: words of eight bytes, ties go on to the next word
    w = _words(text, ">")
    direct = np.flatnonzero(need[:n] & smaller)
    key = w[direct].astype(np.uint64)
    o = np.argsort(key, kind="stable")
    direct, key = direct[o], key[o]
    new = np.ones(len(direct), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    for at in range(8, depth + 8, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        key, group = w[np.minimum(direct[tied] + at, len(w) - 1)].astype(np.uint64), np.cumsum(new)[tied]
        o = np.lexsort((key, group))
        direct[tied] = direct[tied][o]
        key, group = key[o], group[o]
        new[tied] |= np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]

    # second stage: bucket by bucket, in order of the successors' ranks
    rank = np.zeros(n + 1, dtype=np.int64)
    induced = np.flatnonzero(need[:n] & ~smaller)
    level = run_end[induced] - induced
    o = np.lexsort((level, t[induced]))
    induced, level = induced[o], level[o]
    group = t[induced].astype(np.int64) << 40 | level
    cuts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)] if len(group) else np.zeros(1, np.int64)
    direct_char = t[direct]
    out, count, d = [], 1, 0
    for i, j in zip(cuts[:-1], cuts[1:]):
        e = int(np.searchsorted(direct_char, t[induced[i]], side="left"))  # smaller first bytes come before
        rank[direct[d:e]] = count + np.cumsum(new[d:e])
        out.append(direct[d:e])
        count, d = count + e - d + 1, e
        part = induced[i:j]
        key = rank[part + 1]
        o = np.argsort(key, kind="stable")
        part, key = part[o], key[o]
        rank[part] = count + np.cumsum(np.r_[False, key[1:] != key[:-1]])
        out.append(part)
        count += len(part) + 1
    out.append(direct[d:])
    order = np.concatenate(out)
    is_wanted = np.zeros(n + 1, dtype=bool)
    is_wanted[wanted] = True
    return order[is_wanted[order]]


def common_prefix(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Whether neighbours in ``order`` share ``depth`` bytes."""
    w, p, q = _words(text), order[:-1], order[1:]
    equal = np.arange(len(p))
    for at in [*range(0, depth - 8, 8), depth - 8]:
        equal = equal[w[p[equal] + at] == w[q[equal] + at]]
    out = np.zeros(len(p), dtype=bool)
    out[equal] = True
    return out


def repeated_strings(contexts: list[bytes], rid: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (rid, a, b) of the strings in ``contexts`` that also start earlier."""
    size = np.array([len(x) for x in contexts], dtype=np.int64)
    text = np.concatenate([np.frombuffer(b"".join(contexts), np.uint8), np.zeros(PAD, np.uint8)])
    begin = np.cumsum(size) - size
    count = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(size)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    order = suffix_order(text, begin[which] + inner)
    if not len(order):
        return rid[:0], a[:0], a[:0]
    label = np.cumsum(np.r_[0, ~common_prefix(text, order)])
    ctx = np.searchsorted(begin, order, side="right") - 1
    doc, start = rid[ctx], a[ctx] + order - begin[ctx]
    o = np.lexsort((start, doc, label))
    label, doc, start = label[o], doc[o], start[o]
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    lead = np.repeat(first, np.diff(np.r_[first, len(label)]))
    later = (doc != doc[lead]) | (start != start[lead])
    return merged(doc[later], start[later], start[later] + LENGTH)


def slices(texts: list[bytes], off: list[int]):
    """(texts, begins) that hold the strings SLICE distances from their anchor at a time."""
    for d in range(0, SPAN + 1, SLICE):
        lo = [max(0, o - d - SLICE + 1) for o in off]  # the first and the last place of a string
        hi = [min(o - d, len(t) - LENGTH) for t, o in zip(texts, off)]
        yield [t[i : j + LENGTH] if j >= i else b"" for t, i, j in zip(texts, lo, hi)], np.array(lo, np.int64)


def _mixed(h: int, k: int) -> int:
    x = (h + (k + 1) * int(ODD[0])) & (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, rid, a, off, bytes) of ``wanted`` (h, rid, packed, spread), cut from ``docs`` (rid, bytes).

    ``off`` is the anchor's place; contexts to ``spread`` come in slices, each with a hash of its own.
    """
    asked = wanted.groupBy("rid").agg(F.collect_list(F.struct("h", "packed", "spread")).alias("asked"))
    joined = docs.select("rid", "bytes").join(asked, "rid")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            h, rid, at, off, got = [], [], [], [], []
            for r, text, asked in zip(b.column("rid").to_pylist(), b.column("bytes"), b.column("asked").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                for x in asked:
                    s, n, o = x["packed"] >> 32, x["packed"] >> 8 & 0xFF, x["packed"] & 0xFF
                    parts = [(x["h"], 0, raw[s : s + n])]
                    if x["spread"]:
                        parts = [(_mixed(x["h"], k), int(i[0]), t[0]) for k, (t, i) in enumerate(slices([raw[s : s + n]], [o])) if t[0]]
                    for key, i, t in parts:
                        h.append(key), rid.append(r), at.append(s + i), off.append(o - i), got.append(t)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in (h, rid, at, off)], pa.array(got, pa.binary())], ["h", "rid", "a", "off", "bytes"]
            )

    return joined.mapInArrow(run, "h long, rid long, a long, off long, bytes binary")


def sorted_marks(found: DataFrame) -> DataFrame:
    """(rid, packed) marks of repeated strings in ``found`` (h, rid, a, off, bytes), anchors kept whole."""
    ordered = found.repartition("h").sortWithinPartitions("h")

    def run(batches):
        import pyarrow as pa

        empty = lambda: [[], [], [], [], []]

        def result(rows, sliced):
            _, rid, at, off, texts = rows
            rid, at = np.array(rid, np.int64), np.array(at, np.int64)
            for part, inner in slices(texts, off) if sliced else [(texts, 0)]:
                r, a, b = repeated_strings(part, rid, at + inner)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(_pack(a, b) | MARK)], ["rid", "packed"])

        block, group = empty(), empty()  # whole anchors, and the anchor that is open
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if group[0] and r[0] != group[0][-1]:
                    if sum(map(len, group[4])) > BLOCK:
                        yield from result(group, True)
                    else:
                        for x, y in zip(block, group):
                            x.extend(y)
                    group = empty()
                    if len(block[0]) * LENGTH >= BLOCK:
                        yield from result(block, False)
                        block = empty()
                for col, v in zip(group, r):
                    col.append(v)
        if group[0]:
            yield from result(group, sum(map(len, group[4])) > BLOCK)
        if block[0]:
            yield from result(block, False)

    return ordered.mapInArrow(run, "rid long, packed long")


def hot_marks(found: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: equal strings are grouped by a hash of 128 bits."""
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("bytes") - (LENGTH - 1)), lambda i: F.struct(
        F.xxhash64(F.substring(F.col("bytes"), i, LENGTH)).alias("x"), F.xxhash64(F.lit(1), F.substring(F.col("bytes"), i, LENGTH)).alias("y")))).alias("i", "s")
    strings = saved(found.select("rid", "a", at).select("rid", (F.col("a") + F.col("i")).alias("a"), "s.x", "s.y"), "hot-strings")
    first = strings.groupBy("x", "y").agg(F.min(F.struct("rid", "a")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = strings.join(first, ["x", "y"]).filter((F.col("rid") != F.col("first.rid")) | (F.col("a") != F.col("first.a")))
    return later.select("rid", F.shiftleft("a", 32).bitwiseOR(F.col("a") + LENGTH).bitwiseOR(F.lit(MARK)).alias("packed")).distinct()


# ------------------------------------------------------------------- whole
def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_x_rid``: a long, unique to the row, in the documents' order.

    Unique integers serve as they are; any other ids (text, dates, repeated ones) are numbered in their order.
    """
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        n = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
        unique = n["rows"] == n["ids"]
    else:
        unique = False
    if unique:
        return docs.withColumn("_x_rid", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.withColumn("_x_rid", F.monotonically_increasing_id()), "numbered")


def marked(docs: DataFrame) -> DataFrame:
    """(rid, bytes, marks, and the columns of ``docs`` but text): marks are packed spans to cut out, not yet united.

    All joins with the texts are by rid on the same (rid, bytes), so the texts are shuffled once.
    """
    docs = numbered(docs)
    plain = docs.select(F.col("_x_rid").alias("rid"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    found = saved(repeats(anchor_rows(plain)), "repeats")
    open_ = found.filter("packed >= 0")
    busy = saved(open_.groupBy("h").count().filter(F.col("count") > SPREAD), "busy-anchors")
    sized = open_.join(busy, "h", "left").withColumn("spread", F.col("count").isNotNull())
    cool = sized.filter(F.coalesce("count", F.lit(0)) <= HOT)
    marks = found.filter("packed < 0").select("rid", "packed").union(sorted_marks(contexts(plain, cool)))
    if not busy.filter(F.col("count") > HOT).isEmpty():
        hot = sized.filter(F.col("count") > HOT).withColumn("spread", F.lit(False))
        marks = marks.union(hot_marks(contexts(plain, hot)))
    cut = marks.groupBy("rid").agg(F.collect_list("packed").alias("_x_marks"))
    others = docs.withColumn("_x_null", F.col("text").isNull()).drop("text").withColumnRenamed("_x_rid", "rid")
    return plain.join(cut, "rid", "left").join(others, "rid")


def _spans(marks: list[int] | None) -> list[tuple[int, int]]:
    """The united spans, in order."""
    if not marks:
        return []
    x = np.array(marks, dtype=np.int64) & ~np.int64(MARK)
    _, a, b = merged(np.zeros(len(x), np.int64), x >> 32, x & 0xFFFFFFFF)
    return list(zip(a.tolist(), b.tolist()))


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[b for _, b in spans]]
    return b"".join(raw[i:j] for i, j in zip(ends, [*[a for a, _ in spans], len(raw)]))


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs`` (doc_id, text)."""
    rows = marked(docs.select("doc_id", "text")).select("doc_id", "bytes", "_x_marks")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, marks in zip(b.column("bytes").to_pylist(), b.column("_x_marks").to_pylist()):
                spans = _spans(marks)
                out.append((len(raw), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(raw, spans)).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit("").alias("kept_sha256")).schema
    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; what is left of a cut character goes too."""
    columns = docs.columns
    taken = docs.select("doc_id", "text", F.struct(*[docs[c] for c in columns if c != "text"]).alias("_x_row"))
    rows = marked(taken).select("_x_row", "bytes", "_x_marks", "_x_null")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [
                None if none else _kept(raw, _spans(marks)).decode(errors="ignore") if marks else raw.decode()
                for raw, marks, none in zip(*[b.column(c).to_pylist() for c in ("bytes", "_x_marks", "_x_null")])
            ]
            yield pa.RecordBatch.from_arrays([b.column("_x_row"), pa.array(texts, pa.string())], ["_x_row", "text"])

    made = rows.mapInArrow(run, taken.select("_x_row", "text").schema)
    return made.select("_x_row.*", "text").select(*columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
