"""Encoding with a public tokenizer file, fast enough for whole corpora."""

from __future__ import annotations

import os
import sys
import types

import numpy as np

_STOP = r"[^\p{L}\p{N}][.,][ \n]"  # then full stops and commas aren't cut off
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
MARK = "\x01"  # begins a cut that has no space before it
MAX_CACHED = 1_000_000  # cuts that a worker keeps with their ids, some 30 MB
BLOCK = 12 << 20  # bytes of text that are cut at a time
LEARN = 8192  # new cuts that are encoded at a time


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``encode(texts)`` gives the ids of a byte-level BPE of the ``tokenizers`` library.

    Where no two white-space characters meet, a new pre-token begins at every
    space, before and after every line feed, and at a full stop or comma between
    a letter or digit and white space.  So texts can be cut there, and only a
    block's distinct cuts be looked up; the library's results are kept in a
    cache, and new cuts are encoded together, with line feeds between them.
    Other texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for a task
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        line_feed = self._ids("\n")
        # the cuts that can't be encoded among others: a space, nothing, a line feed
        parts = [self._ids(" "), line_feed[:0], line_feed]
        self.line_feed = int(line_feed[0])
        self.first = pa.array(["", MARK, f"{MARK}\n"]), np.concatenate(parts), np.array([len(p) for p in parts], np.int32)
        self.words, self.flat, self.size = self.first

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, cuts) -> None:
        """Encode new cuts (an Arrow array), with line feeds between them, and keep them."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.if_else(pc.starts_with(cuts, MARK), pc.utf8_slice_codeunits(cuts, 1), pc.binary_join_element_wise("", cuts, " "))
        flat, size = [self.flat], [self.size]
        for k in range(0, len(texts), LEARN):  # the library needs much memory for a long text
            part = texts[k : k + LEARN]
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), "\n")
            ids = self._ids(joined[0].as_py())
            feeds = np.flatnonzero(np.r_[ids, np.uint32(self.line_feed)] == self.line_feed)
            flat.append(ids[ids != self.line_feed])
            size.append(np.diff(feeds, prepend=-1).astype(np.int32) - 1)
        self.words = pa.concat_arrays([self.words, cuts])
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)

    def _block(self, texts, stops: bool) -> list[np.ndarray]:
        """Ids of texts (an Arrow array) that can be cut, with ``stops`` also at full stops and commas."""
        import pyarrow.compute as pc

        marked = pc.replace_substring(texts, "\n", f" {MARK}\n {MARK}")
        for c in ".," if stops else "":
            marked = pc.replace_substring(marked, f"{c} ", f" {MARK}{c} ")
        lists = pc.split_pattern(pc.binary_join_element_wise(MARK, marked, ""), " ")
        coded = lists.flatten().dictionary_encode()
        if len(self.words) > MAX_CACHED:
            self.words, self.flat, self.size = self.first
        known = pc.index_in(coded.dictionary, value_set=self.words)
        if known.null_count:
            self._learn(coded.dictionary.filter(known.is_null()))
            known = pc.index_in(coded.dictionary, value_set=self.words)
        begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        which = known.to_numpy()[coded.indices.to_numpy()]
        n = self.size[which]
        ends = np.cumsum(n, dtype=np.int32)  # a block's ids, or a single text's, are below 2^31
        ids = self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(begin[which] - ends + n, n)]
        at = np.r_[0, ends][lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode(self, texts):
        """Yield the ids (unsigned 32-bit) of each text of an Arrow array; null is encoded as the empty text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        size = pc.binary_length(pc.fill_null(texts.cast(pa.string()), "")).to_numpy(zero_copy_only=False)
        upto = np.cumsum(size, dtype=np.int64)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK, side="right")))
            part = pc.fill_null(texts[i:j].cast(pa.string()), "")
            has = lambda p: pc.match_substring_regex(part, p).to_numpy(zero_copy_only=False)
            kind = np.where(has(f"{_SPACE}{{2}}|{MARK}"), 0, np.where(has(_STOP), 1, 2))
            got = [iter(self._block(t, k == 2) if len(t := part.filter(pa.array(kind == k))) else ()) for k in (1, 2)]
            for x, k in enumerate(kind.tolist()):
                yield next(got[k - 1]) if k else self._ids(part[x].as_py())
            i = j
            pa.default_memory_pool().release_unused()  # else a worker keeps what the largest block took


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for ``path``: its cache is kept from task to task."""
    kept = sys.modules.setdefault("_pitwall_encoders", types.ModuleType("_pitwall_encoders"))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return getattr(kept, path)
