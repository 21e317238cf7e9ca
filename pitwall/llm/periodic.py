"""Periodic runs of words by an online sparse dynamic programme over diagonals.

A run is a stretch of words with smallest period q, at least ``max(shortest,
2 * q)`` words long, that no neighbouring word extends.  Words are read from
left to right.  The diagonal of lag q is the state "the last words equal those
q words earlier"; a word's earlier occurrences open diagonals, every further
equal word lengthens them, and the first unequal one ends them: a diagonal that
is long enough then emits its run at once.

Only diagonals that can become runs are opened.  A run's matched part has at
least ``max(q, shortest - q)`` words, so occurrences count with their context:
for lags in [m, 2m), m doubling from ``shortest / 2``, those of the same m words
(exact ranks by doubling, not hashes).  Of occurrences that overlap by half or
more, which continue one another periodically, a pair is looked at only where
one of the two is the first: every matched part begins at such a pair.  A lag
that is a multiple of an open diagonal's with the same start has no run of its
own and isn't opened.  So ``a a a ...`` costs one diagonal, not one a lag.

Defined results: null text: no words; empty text: no run, the digest of nothing;
very long texts: whole, with memory in proportion to the words; ties between
longest runs: least start, then period; repeated rows and null ids: a row each
(a null id plants no run); empty tables: no rows; other columns aren't read by
``find_runs`` and ``digests`` and come back unchanged from ``collapse``.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SHORTEST = 12


def words(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: what bytes.split() takes as words."""
    return (text or "").encode().split()


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of ``keys`` and for each place the place before it with an equal key (-1: none)."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    rank, before = np.zeros(len(keys), np.int64), np.full(len(keys), -1)
    rank[order[1:]] = np.cumsum(~same)
    before[order[1:][same]] = order[:-1][same]
    return rank, before


def _paired(rank: np.ndarray, step: int) -> np.ndarray:
    """Keys of the places' own rank with that ``step`` later."""
    a, b = rank[: len(rank) - step], rank[step:]
    return a * (int(b.max()) + 1) + b


def _openings(ids: np.ndarray, m: int, before: np.ndarray, low: int) -> np.ndarray:
    """(x, lag) where a matched part of lag in [low, 2m) begins at word x, from the places of equal m words."""
    at = np.arange(len(before))
    first = (before < 0) | (at - before > m // 2)
    order = np.lexsort((at, _chain(before)))
    lead = np.empty(len(at), np.int64)  # the nearest first one, itself included
    lead[order] = order[np.maximum.accumulate(np.where(first[order], at, 0))]
    x = at[before >= 0]
    j = np.where(first[x], before[x], lead[x])
    found = []
    while len(x):
        near = (j >= 0) & (x - j < 2 * m)
        x, j = x[near], j[near]
        hit = x - j >= low
        a, b = x[hit], j[hit]
        begins = (b == 0) | (ids[a - 1] != ids[b - 1])
        found.append(np.stack([a[begins], a[begins] - b[begins]], axis=1))
        back = before[j]
        j = np.where(first[x] | (back < 0), back, lead[back])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _chain(before: np.ndarray) -> np.ndarray:
    """The first place of each place's chain of equal keys."""
    head = np.where(before < 0, np.arange(len(before)), before)
    while True:
        up = head[head]
        if np.array_equal(up, head):
            return head
        head = up


def runs(ids: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word numbers ``ids``, by start, then period."""
    n, m = len(ids), max(1, -(-shortest // 2))
    if n < max(2, shortest):
        return []
    rank, before = _ranks(ids)
    width = 1
    while width < m:  # ranks of m words, from those of half as many or more
        if not (before >= 0).any():
            return []
        step = min(width, m - width)
        rank, before = _ranks(_paired(rank, step))
        width += step
    opened, low = [], 1
    while True:
        if not (before >= 0).any():
            break
        opened += [(x + m - 1, q, x) for x, q in _openings(ids, m, before, low).tolist()]
        if 4 * m > n:  # a run of a lag from 2m on has 4m words
            break
        rank, before = _ranks(_paired(rank, m))
        m *= 2
        low = m
    opened.sort()
    word = ids.tolist()
    active: dict[int, int] = {}  # lag: first word of the matched part
    out: dict[tuple[int, int], int] = {}
    i = k = 0
    while k < len(opened) or active:
        i = i + 1 if active else opened[k][0]
        if active:
            ended = [q for q in active if i == n or word[i - q] != word[i]]
            for q in sorted(ended):
                x = active.pop(q)
                if i - x >= max(q, shortest - q):
                    out.setdefault((x - q, i - x + q), q)
        while k < len(opened) and opened[k][0] == i:
            _, q, x = opened[k]
            k += 1
            if not any(q % d == 0 and y - d == x - q for d, y in active.items()):
                active[q] = x
    return sorted((s, length, q) for (s, length), q in out.items())


def numbered(found: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(found))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, q in found:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:n]) == 0


def _planted(doc_id, found: list[bytes]) -> list[bytes]:
    """The words with the run that the contract plants in a tenth of the documents."""
    h, n = zlib.crc32(str(doc_id).encode()), len(found)
    if doc_id is None or h % 10 or not n:
        return found
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = found[a : a + p]
    return found[:a] + (block * (-(-(n - a) // p)))[: n - a]


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """A row per run: doc_id, start, length, period (words) and ``phrase``, the words of its first period."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = {c: [] for c in schema.names}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                for s, length, q in runs(numbered(w), shortest):
                    for c, v in zip(out, (i, s, length, q, b" ".join(w[s : s + q]).decode())):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), [b.schema.types[0], *[pa.int64()] * 3, pa.string()])],
                                             list(out))

    lit = F.lit(None)
    schema = docs.select("doc_id", *[lit.cast("long").alias(c) for c in ("start", "length", "period")], lit.cast("string").alias("phrase")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def collapse(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with each run cut to its first period: texts that hold a run become their kept words, joined by spaces."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = b.column("text").to_pylist()
            for k, t in enumerate(texts):
                w = words(t)
                found = runs(numbered(w), shortest)
                if found:
                    texts[k] = b" ".join(np.array(w, object)[kept(len(w), found)]).decode()
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


NUMBERS = ("n_runs", "start", "length", "period", "exponent_milli")
DIGESTS = ("runs_sha256", "collapsed_sha256")


def digests(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row per document: its number of runs, the longest one, digests of all runs and of the collapsed words.

    With ``plant``, a tenth of the documents get the run of the contract first.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words(t)
                w = _planted(i, w) if plant else w
                found = runs(numbered(w))
                best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                exponent = 1000 * best[1] // best[2] if found else None
                listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
                rest = b" ".join(np.array(w, object)[kept(len(w), found)]) if found else b" ".join(w)
                out.append((len(found), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(v, pa.int64() if k < 5 else pa.string()) for k, v in enumerate(columns)],
                                             ["doc_id", *NUMBERS, *DIGESTS])

    lit = F.lit(None)
    schema = docs.select("doc_id", *[lit.cast("long").alias(c) for c in NUMBERS], *[lit.cast("string").alias(c) for c in DIGESTS]).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), plant=True)
