"""SentencePiece encoding with byte spans of the source, and decoding.

A text is normalised here, not in the library: at each place the longest prefix
in the model's compiled character map (a double-array trie, then the
replacements) is replaced, any other character kept, and for every byte written
the place of the source character is recorded.  White space is then collapsed,
escaped and prefixed as the model says, with the record kept in step.  The
normalised text is segmented, and each piece's begin and end are looked up in
the record: its byte span in the original.

The library segments the normalised text with its own normalisation switched
off; a piece's width there is that of its spelling, one byte for a byte piece
(whose record leads to its character's begin), or, if the text has characters
without a piece, what the library reports.

Defined results: null or empty texts: no pieces, the empty text back; very long
texts: whole, memory in proportion to the text; an unknown character's byte
pieces: the last spans the character, the others its begin; repeated rows and
null ids: a row each; empty tables: no rows; other columns aren't read.  Models
with user-defined pieces are refused (they bypass the character map).
"""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
USER_DEFINED, BYTE = 4, 6  # kinds of pieces, fixed values of the model format
BATCH_BYTES = 4 << 20  # of text, whose spans are given out together


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes):
    """(number, value) of the fields of a protobuf message: an int, or bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


class CharMap:
    """Longest-prefix replacement by a compiled character map; an empty one keeps every text."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]
        starts = np.zeros(256, bool)
        if self.units:
            root = self._offset(self.units[0])
            for c in range(1, 256):
                starts[c] = self._label(root ^ c) == c
        self.starts = starts

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _label(self, at: int) -> int:
        return self.units[at] & 0x800000FF if at < len(self.units) else -1

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest rule that ``raw`` holds at ``at``."""
        node, found = self._offset(self.units[0]), None
        for k in range(at, len(raw)):
            node ^= raw[k]
            if self._label(node) != raw[k]:
                break
            unit = self.units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                begin = self.units[node] & 0x7FFFFFFF
                found = k + 1 - at, begin
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def replaced(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after the replacements; each one's source begin; is it one of the spaces that a unit begins with; is it a whole unit."""
        given = np.frombuffer(raw, np.uint8)
        place = np.arange(len(given))
        begin = np.maximum.accumulate(np.where((given & 0xC0) == 0x80, 0, place)) if len(given) else place
        space = given == 32
        parts, cursor = [], 0
        for at in np.flatnonzero(self.starts[given]).tolist():
            if at >= cursor and begin[at] == at and (rule := self.longest(raw, at)):
                s = slice(cursor, at)
                parts.append((given[s], begin[s], space[s], space[s]))
                text = np.frombuffer(rule[1], np.uint8)
                lead = np.arange(len(text)) < len(rule[1]) - len(rule[1].lstrip(b" "))
                parts.append((text, np.full(len(text), at), lead, lead & (rule[1] == b" ")))
                cursor = at + rule[0]
        s = slice(cursor, None)
        parts.append((given[s], begin[s], space[s], space[s]))
        return tuple(np.concatenate(p) for p in zip(*parts))


class Pieces:
    """Normalisation, segmentation and spans for one model file."""

    def __init__(self, path: str | None = None, blob: bytes | None = None):
        import sentencepiece

        if blob is None:
            with open(path, "rb") as f:
                blob = f.read()
        fields = list(_fields(blob))
        trainer = dict(_fields(b"".join(v for k, v in fields if k == 2)))
        spec = dict(_fields(b"".join(v for k, v in fields if k == 3)))
        self.map = CharMap(spec.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        if any(p.get(3, 1) == USER_DEFINED for p in pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.width = np.array([1 if p.get(3, 1) == BYTE else len(p[1]) for p in pieces])
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        off = bytes([0x12, 0, 0x18, 0, 0x20, 0, 0x28, 0])  # no map, prefix, squeezing or escaping: later fields win
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=blob + bytes([0x1A, len(off)]) + off)
        self.unknown = self.lib.unk_id()

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and for each of its bytes, and its end, the byte of the source."""
        raw = text.encode()
        out, source, lead, alone = self.map.replaced(raw)
        end, begin = len(raw), 0
        if self.squeeze:
            skipped = len(alone) if alone.all() else int(np.argmin(alone))
            if skipped == len(out):
                return b"", np.array([end])
            begin = int(source[skipped])
            after_space = np.r_[True, out[:-1] == 32]
            keep = ~(lead & after_space)
            out, source = out[keep], source[keep]
        elif not len(out):
            return b"", np.array([end])
        space = SPACE.encode() if self.escape else b" "
        text = bytes(out)
        if self.dummy and not self.suffix:
            text, source = b" " + text, np.r_[begin, source]
        if self.escape:
            source = np.repeat(source, np.where(np.frombuffer(text, np.uint8) == 32, len(space), 1))
            text = text.replace(b" ", space)
        if self.squeeze:
            while text.endswith(space):
                text = text[: -len(space)]
            end = int(np.r_[source, end][len(text)])
            source = source[: len(text)]
        if self.dummy and self.suffix:
            text, source = text + space, np.r_[source, [end] * len(space)]
        return text, np.r_[source, end]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, ends): the pieces of a text and their byte spans in its UTF-8 form."""
        norm, source = self.normalised(text or "")
        ids = np.array(self.inner.encode(norm, num_threads=1), np.int32)
        if self.unknown in ids:
            width = np.array([p.end - p.begin for p in self.inner.encode(norm, return_type="proto").pieces], np.int64)
        else:
            width = self.width[ids]
        ends = np.cumsum(width, dtype=np.int64)
        return ids, source[ends - width], source[ends]

    def decode(self, ids) -> str:
        return self.lib.decode(ids if isinstance(ids, list) else np.asarray(ids).tolist())


def pieces(path: str) -> Pieces:
    """The encoder of this worker process for ``path``: it is loaded once, not for each task."""
    kept = sys.modules.setdefault("_pitwall_pieces", types.ModuleType("_pitwall_pieces"))
    if path not in vars(kept):
        setattr(kept, path, Pieces(path))
    return getattr(kept, path)


def _blocks(batch):
    """Parts of a batch of (id, text) with some megabytes of text."""
    begin = size = 0
    for k, t in enumerate(batch.column(1)):
        size += t.as_buffer().size if t.is_valid else 0
        if size >= BATCH_BYTES:
            yield batch.slice(begin, k + 1 - begin)
            begin, size = k + 1, 0
    yield batch.slice(begin)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, begins, ends): each document's pieces and the byte spans of its text that they come from."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for whole in batches:
            for b in _blocks(whole):
                got = [p.encode(t) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array([list(g[k]) for g in got], pa.list_(pa.int32())) for k in range(3)],
                                                 ["doc_id", "ids", "begins", "ends"])

    schema = docs.select("doc_id", *[F.lit(None).cast("array<int>").alias(c) for c in ("ids", "begins", "ends")]).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with ``ids``; null ids give the empty text."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    schema = rows.select("doc_id", F.lit(None).cast("string").alias("text")).schema
    return rows.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_covered): of ids, the decoded text, and the bytes that spans cover."""
    path = path or model_path()

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for b in batches:
            out = []
            for t in b.column(1):
                ids, begins, ends = p.encode(t.as_py())
                listed = ids.tolist()
                out.append((len(listed), hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(),
                            hashlib.sha256(p.decode(listed).encode()).hexdigest(), int((ends - begins).sum())))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"])

    lit = F.lit(None)
    schema = docs.select("doc_id", *[lit.cast(t).alias(c) for c, t in (
        ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), ("n_covered", "long"))]).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
