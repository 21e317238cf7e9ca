"""Quality classifier: a factorisation machine on words, structure and length.

A text becomes a sparse vector: its lower-cased words hashed into ``WORDS``
buckets (log counts, unit length), and one-hot bins of structure statistics
(letter case, symbols, repetition, line and word lengths) and of the recorded
``n_chars``.  The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

all pairwise interactions in time linear in the non-zero entries.  The model is
fitted by AdaGrad on at most ``MAX_TRAIN`` labelled documents, the first by the
hash of their id; only their vectors (at most ``WORDS`` numbers each) come to the
driver.  Scoring reads every whole text, partition by partition.

Null and empty texts are scored by their structure bins alone; a null or wrong
``n_chars`` is a bin of its own or any other.  Repeated rows get equal scores.
Without usable labels every score is one half.  Different labels of one id are
each a training row; null labels are left out.  Very long texts are scored whole;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS = 1 << 14
BINS = 16
FACTORS = 6
MAX_TRAIN = 6000
EPOCHS = 12
BATCH = 64
RATE = 0.08
DECAY = 2e-4
THRESHOLD = 0.3
FOLDS = 5
SYMBOLS = np.zeros(256)
SYMBOLS[list(b"#*$%&|<>=+~^@\\{}[]")] = 1
STOPS = np.zeros(256)
STOPS[list(b".,;:!?")] = 1
STATS = 13
SIZE = WORDS + STATS * BINS


def _log_bin(r: float) -> int:
    """0 for nothing, then halvings from 1/8192 up."""
    return 0 if r <= 0 else int(np.clip(np.log2(r) + 14, 1, BINS - 1))


def features(text: str | None, n_chars: int | None, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of a text's non-zero entries; ``buckets`` is a cache of word hashes."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256) if text else np.zeros(256)
    words = text.lower().split()
    counts = Counter(words)
    n, size, lines = max(1, len(words)), max(1.0, float(raw.sum())), text.split("\n")
    upper, lower = float(raw[65:91].sum()), float(raw[97:123].sum())
    stats = (
        _log_bin(upper / max(1.0, upper + lower)),
        _log_bin(float(raw @ SYMBOLS) / size),
        _log_bin(float(raw @ STOPS) / size),
        _log_bin(float(raw[33]) / size),  # exclamation marks
        _log_bin(float(raw[48:58].sum()) / size),
        _log_bin(1 - len(set(lines)) / len(lines)),
        _log_bin(1 - len(counts) / n) if words else BINS - 1,
        _log_bin(sum(map(eq, words, words[1:])) / n),
        _log_bin(max(counts.values(), default=0) / n),
        int(min(BINS - 1, (size - raw[32] - raw[10]) / n)),  # word length in bytes
        int(min(BINS - 1, np.log2(n))) if words else BINS - 1,
        int(min(BINS - 1, np.log2(n / len(lines) + 1))),
        BINS - 1 if n_chars is None or n_chars < 0 else int(min(BINS - 2, np.log2(n_chars + 1))),
    )
    if len(buckets) + len(counts) > 400_000:
        buckets.clear()
    for w in counts:
        if w not in buckets:
            buckets[w] = zlib.crc32(w.encode()) % WORDS
    index = np.fromiter((buckets[w] for w in counts), np.int64, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(index):
        index, at = np.unique(index, return_inverse=True)
        value = np.bincount(at, weights=value)
        value /= np.sqrt(value @ value)
    one_hot = WORDS + BINS * np.arange(STATS) + np.array(stats)
    return np.r_[index, one_hot], np.r_[value, np.full(STATS, 0.5)]


class Machine:
    """w0, w and v of a factorisation machine."""

    def __init__(self, size: int = SIZE, factors: int = FACTORS):
        rng = np.random.default_rng(7)
        self.w0, self.w, self.v = 0.0, np.zeros(size), rng.normal(0, 0.02, (size, factors))

    def raw(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the factor sums, of ``rows`` sparse rows laid end to end."""
        vx = self.v[index] * value[:, None]
        sums = np.stack([np.bincount(row, weights=vx[:, f], minlength=rows) for f in range(vx.shape[1])], axis=1)
        squares = np.bincount(row, weights=(vx * vx).sum(axis=1), minlength=rows)
        linear = np.bincount(row, weights=self.w[index] * value, minlength=rows)
        return self.w0 + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> "Machine":
        rate = np.clip(labels.mean(), 0.01, 0.99)
        self.w0 = float(np.log(rate / (1 - rate)))
        gw, gv, g0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                batch = order[k : k + BATCH]
                index = np.concatenate([rows[i][0] for i in batch])
                value = np.concatenate([rows[i][1] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
                z, sums = self.raw(index, value, row, len(batch))
                error = (1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)
                d = error[row] * value
                used, at = np.unique(index, return_inverse=True)
                dw = np.bincount(at, weights=d) + DECAY * self.w[used]
                per = d[:, None] * (sums[row] - self.v[index] * value[:, None])
                dv = np.stack([np.bincount(at, weights=per[:, f]) for f in range(per.shape[1])], axis=1) + DECAY * self.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                g0 += error.sum() ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])
                self.w0 -= RATE * error.sum() / np.sqrt(g0)
        return self


def training_rows(docs: DataFrame, labelled: DataFrame, limit: int = MAX_TRAIN) -> tuple[list, np.ndarray]:
    """Vectors and labels of the first ``limit`` labelled documents by hash of the id.

    Of rows that share an id the one with the least text counts (null first), so at most ``limit`` come to the driver.
    """
    few = labelled.filter("label IS NOT NULL").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)
    rows = docs.select("doc_id", "text", "n_chars").join(F.broadcast(few), "doc_id")  # at most ``limit`` rows
    first = F.min(F.struct("text", "n_chars")).alias("first")
    rows = rows.groupBy("doc_id", "label").agg(first).select("label", "first.text", "first.n_chars")

    def run(batches):
        import pyarrow as pa

        buckets: dict[str, int] = {}
        for b in batches:
            got = [features(t, n, buckets) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("label").cast(pa.float64()), pa.array([i.tolist() for i, _ in got], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in got], pa.list_(pa.float32()))],
                ["label", "index", "value"],
            )

    got = rows.mapInArrow(run, "label double, index array<int>, value array<float>").toArrow().combine_chunks()
    made = []
    for k in range(len(got)):  # views of the Arrow columns, no Python lists
        index, value = (got.column(c)[k].values.to_numpy() for c in ("index", "value"))
        made.append((index.astype(np.int64), value.astype(np.float64)))
    order = sorted(range(len(made)), key=lambda k: (made[k][0].tolist(), made[k][1].tolist()))  # the same model in any row order
    return [made[k] for k in order], got.column("label").to_numpy()[order] if len(made) else np.zeros(0)


def train(docs: DataFrame, labelled: DataFrame) -> Machine | None:
    rows, labels = training_rows(docs, labelled)
    return Machine().fit(rows, labels) if len(rows) else None


def score(docs: DataFrame, model: Machine | None) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text, n_chars)."""

    def run(batches):
        import pyarrow as pa

        buckets: dict[str, int] = {}
        for b in batches:
            out = []
            for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist()):
                if model is None:
                    out.append(0.5)
                    continue
                index, value = features(t, n, buckets)
                vx = model.v[index] * value[:, None]
                s = vx.sum(axis=0)
                out.append(float(1 / (1 + np.exp(-(model.w0 + model.w[index] @ value + 0.5 * (s @ s - (vx * vx).sum()))))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema
    return docs.select("doc_id", "text", "n_chars").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def op2_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").cast("double").alias("label")))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
