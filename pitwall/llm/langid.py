"""Language identification of mixed texts: script ranges, then Viterbi over words.

A word (a run of letters) is scored for each learned language by its hashed
character trigrams.  The script of its first letter narrows the candidates to
the languages that were seen in that script; the others can't label the word.  The labels of a text's words are
the Viterbi path under a penalty for every switch of language, so a text of
several languages becomes a few spans; the language with the most letters is the
text's, and its share of the letters the score.

The model (log frequencies, ``BUCKETS`` numbers a language) is counted on about
``PER_LANG`` labelled documents of each language, chosen by hash of the id, and
sent to the tasks; it learns the ``MAX_LANGS`` languages with the most documents (ties:
the alphabetically first), so it is bounded however many values ``lang`` has.  Prediction reads every whole text: the path is computed for
a block of documents at a time, word by word across the block.

Null texts and texts without a letter are ``und`` with score 0 and no spans.
Ties go to the alphabetically first language.  Repeated rows get equal results;
without labelled documents everything is ``und``; an empty table gives no rows;
columns other than doc_id, text and (for training) lang are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BUCKETS = 1 << 13
PER_LANG = 1500
MAX_LANGS = 256  # 17 MB of numbers
SWITCH = 8.0
WEIGHT = 0.5  # overlapping trigrams count about half
NARROWED = -np.inf  # a language that was not seen in the word's script
MIN_SHARE = 0.01  # of a language's words that a script needs
FOLDS, OUT = 3, 1
BLOCK_WORDS = 2_000_000
MAX_WORDS = 300_000  # scored words that a worker keeps
MANY = 16  # languages; with more of them blocks and kept words get fewer
WORD = re.compile(r"[^\W\d_]+")
# Unicode ranges: first code point and script; what lies before the next begins there
SCRIPTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
_FIRST = [a for a, _ in SCRIPTS]
_NAMES = sorted({s for _, s in SCRIPTS})


def script(word: str) -> int:
    return _NAMES.index(SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1])


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    return [zlib.crc32(w[i : i + 3].encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(w) - 2)]


def counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n): counts of trigram buckets, and behind them of scripts, in ``docs`` (lang, text)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                at = made.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                words = WORD.findall((text or "").lower())
                if words:
                    np.add.at(at, [g for w in words for g in grams(w)], 1)
                    np.add.at(at, [BUCKETS + script(w) for w in words], 1)
            for lang, at in made.items():
                k = np.flatnonzero(at)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(at[k])], ["lang", "key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Languages (sorted) and their log frequencies; at most BUCKETS numbers a language."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        """``lang``, ``key``, ``n``: counts of a key, with the language's place in ``langs``."""
        self.langs = langs
        seen = np.zeros((BUCKETS + len(_NAMES), len(langs)))
        seen[key, lang] = n
        freq = seen[:BUCKETS] + 0.5
        self.logs = WEIGHT * np.log(freq / freq.sum(axis=0))
        scripts = seen[BUCKETS:]
        known = scripts >= np.maximum(1, MIN_SHARE * scripts.sum(axis=0))
        known[~known.any(axis=1)] = True  # a script no language was seen in narrows nothing
        self.narrow = np.where(known, 0.0, NARROWED)

    def score(self, word: str) -> np.ndarray:
        return self.logs[grams(word)].sum(axis=0) + self.narrow[script(word)]


def viterbi(scores: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of ``words`` (rows of ``scores``) of documents that begin at ``starts``, all documents at once."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    top = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(top), side="left")  # documents longer than t come first
    best = np.zeros((int(alive[0]) if top else 0, scores.shape[1]))
    moved, came = [], []  # of each step: where a switch is better, and from which language
    for t, k in enumerate(alive.tolist()):
        part = best[:k]
        if t:
            lead = part.argmax(axis=1)
            limit = part[np.arange(k), lead][:, None] - switch
            moved.append(part < limit)
            came.append(lead.astype(np.int16))
            np.maximum(part, limit, out=part)
        part += scores[words[at[:k] + t]]
    labels = np.zeros(len(words), dtype=np.int16)
    state = best.argmax(axis=1)
    for t in range(top - 1, -1, -1):
        k = int(alive[t])
        labels[at[:k] + t] = state[:k]
        if t:
            here = np.arange(k)
            state[:k] = np.where(moved[t - 1][here, state[:k]], came[t - 1], state[:k])
    return labels


class Labeller:
    """Spans and languages of texts; keeps the scores of words it has seen."""

    def __init__(self, model: Model):
        self.model, self.rows, self.known = model, np.zeros((1 << 12, len(model.langs))), {}
        self.letters = np.zeros(1 << 12, np.int64)  # of each known word; digits like ² aren't letters
        self.fewer = max(1, len(model.langs) // MANY)

    def _ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            i = known[w] = len(known)
            if i == len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.rows[i] = self.model.score(w)
            self.letters[i] = len(w) if w.isalpha() else sum(map(str.isalpha, w))
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def block(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans) of each text; a span is (language, first word, words)."""
        if len(self.known) > MAX_WORDS // self.fewer:
            self.known.clear()
        words = [WORD.findall(t.lower()) for t in texts]
        n = np.array([len(w) for w in words], dtype=np.int64)
        ids = np.concatenate([self._ids(w) for w in words]) if len(words) else np.zeros(0, np.int64)
        size = self.letters[ids]
        starts = np.cumsum(n) - n
        labels = viterbi(self.rows, ids, starts, n)
        langs, out = self.model.langs, []
        for s, k in zip(starts.tolist(), n.tolist()):
            if not size[s : s + k].any():
                out.append(("und", 0.0, []))
                continue
            own = labels[s : s + k]
            letters = np.bincount(own, weights=size[s : s + k], minlength=len(langs))
            first = np.r_[0, np.flatnonzero(own[1:] != own[:-1]) + 1]
            runs = np.diff(np.r_[first, k])
            spans = [(langs[own[f]], int(f), int(r)) for f, r in zip(first, runs)]
            top = int(letters.argmax())
            out.append((langs[top], float(letters[top] / letters.sum()), spans))
        return out


def train(docs: DataFrame, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS) -> Model:
    """A model of about ``per_lang`` rows of each of ``max_langs`` languages of ``docs`` (doc_id, text, lang), by hash of the id."""
    import pyarrow as pa

    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    share = usable.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(max_langs)
    share = share.select(F.col("lang"), F.least(F.lit(1.0), per_lang / F.col("rows")).alias("share"))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    few = usable.join(F.broadcast(share), "lang").filter(hashed < F.col("share"))  # at most ``max_langs`` rows
    got = counts(few).toArrow().combine_chunks()
    values = got.column("lang").unique().to_pylist()
    langs = sorted(values)
    place = np.array([langs.index(x) for x in values], np.int64)
    at = np.zeros(0, np.int64)
    if len(got):
        at = place[pa.concat_arrays(got.column("lang").chunks).dictionary_encode().indices.to_numpy()]
    return Model(langs, at, got.column("key").to_numpy(), got.column("n").to_numpy())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        import pyarrow as pa

        span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])
        labeller = Labeller(model)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            got, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= 4 * BLOCK_WORDS // labeller.fewer):
                    size += len(texts[j])
                    j += 1
                got += labeller.block(texts[i:j]) if model.langs else [("und", 0.0, [])] * (j - i)
                i = j
            spans = pa.array([[dict(zip(("lang", "first_word", "words"), s)) for s in x[2]] for x in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), spans],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    schema = docs.select(
        "doc_id", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score"),
        F.lit(None).cast("array<struct<lang:string,first_word:int,words:int>>").alias("spans"),
    ).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == OUT, F.lit(False))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
