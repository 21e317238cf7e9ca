"""Packing into sequences of at most 1,024 tokens by non-negative least squares.

Every document is cut into full windows, each a sequence of its own, and a rest
shorter than a window.  The histogram of the rests' lengths (at most 1,023
rows) goes to the driver, where the combinations of two or three lengths that
fill a window exactly are enumerated and their repeat counts solved against the
histogram by non-negative least squares, rounded, and never set beyond what is
left.  The rests that no combination takes are packed greedily: laid end to end
in order of length, and cut at every window's end, so that only the last
sequence of all can be short.

A rest finds its place by its rank among the rests of its length: its rank in
its task plus the count in earlier tasks, so no length, however frequent, is
numbered in one task.  Null texts count as empty ones (one token, the end id).
Very long texts are cut into as many windows as they need.  Repeated rows are
packed each for itself; an empty table gives no pieces; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .tokens import byte_bpe_path, encoder

SIZE = 1024
END_ID = 0
ROUNDS = 200  # of the least-squares solver


def combinations(hist: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of present lengths that sum to ``size``; c is 0 for a pair."""
    present = np.flatnonzero(hist[:size])
    present = present[present > 0]
    has = np.zeros(size + 1, dtype=bool)
    has[present] = True
    out = []
    for c in [0, *present]:
        rest = size - c
        b = present[(present >= c) & (2 * present <= rest)]
        a = rest - b
        ok = has[a] & (a < size)
        out.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3), dtype=int)


def solve(combos: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |Ax - hist|^2, by accelerated projected gradient."""
    flat = combos.ravel()
    use = np.bincount(flat, minlength=len(hist)).astype(float)
    use[0] = 0
    target = hist.astype(float).copy()
    target[0] = 0
    step = 1.0 / max(1.0, 3.0 * use.max())
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(rounds):
        got = np.bincount(flat, weights=np.repeat(y, 3), minlength=len(hist))
        got[0] = 0
        error = got - target
        new = np.maximum(0.0, y - step * error[flat].reshape(-1, 3).sum(axis=1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


class Plan:
    """Where the rest of length ``n`` and rank ``r`` lies; at most some ten thousand numbers."""

    def __init__(self, hist: np.ndarray, size: int = SIZE):
        hist = hist.astype(np.int64)
        self.size = size
        left = hist.copy()
        left[0] = 0
        combos = combinations(hist, size)
        x = solve(combos, hist) if len(combos) else np.zeros(0)
        taken = np.zeros(len(combos), dtype=np.int64)
        order = np.argsort(-x, kind="stable")
        for want in (np.rint(x).astype(np.int64), np.full(len(x), hist.sum())):  # rounded, then what still fits
            for i in order:
                if want[i]:
                    lens, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
                    n = min(int(want[i] - taken[i]), int((left[lens] // times).min()))
                    if n > 0:
                        taken[i] += n
                        left[lens] -= n * times
        # of each length: ranks up to ``upto`` lie in ``times`` slots of sequences from ``first``
        self.slots: dict[int, list[tuple[int, int, int, int]]] = {}
        self.sequences = 0
        used = np.zeros(size, dtype=np.int64)
        for i in np.flatnonzero(taken):
            at = 0
            lens, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
            for n, k in zip(lens.tolist(), times.tolist()):
                used[n] += k * int(taken[i])
                self.slots.setdefault(n, []).append((int(used[n]), k, self.sequences, at))
                at += n * k
            self.sequences += int(taken[i])
        self.used = used
        self.upto = {n: np.array([s[0] for s in v]) for n, v in self.slots.items()}
        spare = (hist[:size] - used) * np.arange(size)
        self.base = np.cumsum(spare) - spare  # of each length: where its spare rests begin, end to end

    def place(self, n: int, rank: int) -> list[tuple[int, int, int]]:
        """(sequence, offset, length) of the pieces of a rest."""
        if rank < self.used[n]:
            s = int(np.searchsorted(self.upto[n], rank, side="right"))
            _, times, first, at = self.slots[n][s]
            local = rank - (int(self.upto[n][s - 1]) if s else 0)
            return [(first + local // times, at + local % times * n, n)]
        at = int(self.base[n]) + (rank - int(self.used[n])) * n
        out = []
        while n:
            k = min(n, self.size - at % self.size)
            out.append((self.sequences + at // self.size, at % self.size, k))
            at, n = at + k, n - k
        return out


def _encoded(docs: DataFrame, path: str, size: int) -> DataFrame:
    """A row for each document: its task, its counts, the crc of its windows and the ids of its rest."""
    kept = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, enc = TaskContext.get().partitionId(), encoder(path)
        seen, windows = np.zeros(size, dtype=np.int64), 0
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for ids in enc.encode(b.column("text")):
                ids = np.append(ids, np.uint32(END_ID))
                full, n = divmod(len(ids), size)
                row = (len(ids), windows, [zlib.crc32(ids[k * size : (k + 1) * size]) for k in range(full)], n, int(seen[n]), ids[full * size :].tobytes())
                windows += full
                seen[n] += 1
                for c, v in zip(cols, row):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([task] * b.num_rows, pa.int32()), *[pa.array(c, t) for c, t in zip(cols, types)]],
                ["doc_id", "task", "n", "windows", "crcs", "rest", "rank", "ids"],
            )

    schema = kept.select(
        "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (
            ("task", "int"), ("n", "long"), ("windows", "long"), ("crcs", "array<long>"), ("rest", "int"), ("rank", "long"), ("ids", "binary"))]
    ).schema
    return kept.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their sequence and offset."""
    rows = saved(_encoded(docs, tokenizer or byte_bpe_path(), size), "rests")
    counts = rows.groupBy("task", "rest").agg(F.count("*").alias("count"))
    hist = np.zeros(size, dtype=np.int64)
    for r in counts.groupBy("rest").agg(F.sum("count").alias("n")).collect():  # at most ``size`` rows
        hist[r["rest"]] = r["n"]
    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "rest", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    plan = Plan(hist, size)

    def place(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            which, cols = [], [[] for _ in names[1:]]
            rest = [b.column(c).to_pylist() for c in ("task", "n", "windows", "crcs", "rest", "rank", "ids", "before")]
            for i, (task, n, windows, crcs, short, rank, ids, first) in enumerate(zip(*rest)):
                pieces = [(k * size, size, crc, n, (task + 1 << 40) + windows + k, 0) for k, crc in enumerate(crcs)]
                at = 0
                for sequence, offset, k in plan.place(short, rank + first) if short else ():
                    pieces.append((len(crcs) * size + at, k, zlib.crc32(ids[4 * at : 4 * (at + k)]), n, sequence, offset))
                    at += k
                which += [i] * len(pieces)
                for p in pieces:
                    for c, v in zip(cols, p):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(which, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names
            )

    ranked = rows.join(before, ["task", "rest"])
    schema = docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]).schema
    return ranked.mapInArrow(place, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
