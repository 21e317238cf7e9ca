"""Encoding with byte spans against the sentencepiece library, also with other character maps."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pitwall.llm import pieces

BLOB = open(pieces.model_path(), "rb").read()
TEXT = st.lists(st.sampled_from(list("ab \n\t.,1é日😀▁ﬁ１\x00　¨ｶﾞ́​ⅷ") + ["  ", "the", " and", "<s>", "ing "]), max_size=30).map("".join)


def message(tag, raw):
    size, n = b"", len(raw)
    while n > 127:
        size, n = size + bytes([n & 127 | 128]), n >> 7
    return bytes([tag]) + size + bytes([n]) + raw


def variant(rule, flags=b""):
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    chars = dict(pieces._fields(dict(pieces._fields(spec))[3])).get(2, b"")
    return pieces.Pieces(blob=BLOB + message(0x1A, message(0x12, chars) + flags))


MODELS = {
    "own": pieces.Pieces(blob=BLOB),
    "nmt_nfkc": variant("nmt_nfkc"),
    "folded, squeezed": variant("nmt_nfkc_cf", bytes([0x20, 1])),
    "squeezed, no prefix": variant("nfkc", bytes([0x18, 0, 0x20, 1])),
    "prefix, kept spaces": variant("nfkc_cf", bytes([0x18, 1, 0x20, 0])),
}


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=300, deadline=None)
@given(text=TEXT)
def test_pieces_and_spans_equal_the_library(name, text):
    p = MODELS[name]
    ids, begins, ends = p.encode(text)
    want = [(x.id, x.begin, x.end) for x in p.lib.encode(text, return_type="proto").pieces]
    assert list(zip(ids.tolist(), begins.tolist(), ends.tolist())) == want
    assert p.decode(ids) == p.lib.decode(p.lib.encode(text))


def test_the_longest_rule_wins():
    chars = MODELS["nmt_nfkc"].map
    assert chars.longest("ｶﾞ".encode(), 0) == (6, "ガ".encode())
    assert chars.longest("ｶx".encode(), 0) == (3, "カ".encode())
    assert chars.longest(b"x", 0) is None


def test_spans_of_the_own_model_cover_the_text():
    text = "Déjà vu  日本 😀\n"
    ids, begins, ends = MODELS["own"].encode(text)
    raw = text.encode()
    assert b"".join(raw[b:e] for b, e in zip(begins, ends)) == raw


def test_models_with_user_defined_pieces_are_refused():
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Pieces(blob=BLOB + message(0x0A, message(0x0A, b"[X]") + bytes([0x18, 4])))


ROWS = [(1, None), (2, ""), (3, " "), (4, "naïve café"), (4, "naïve café"), (None, "x"), (6, "word " * 40_000), (7, "▁ <0x41> </s> \x00"), (8, "a" * 20_000)]


def test_tables(spark):
    docs = spark.createDataFrame([(*r, "kept", 5) for r in ROWS], "doc_id long, text string, ids string, begins int")
    rows = pieces.encode(docs)
    lib = MODELS["own"].lib
    got = sorted(((r.doc_id, list(r.ids)) for r in rows.collect()), key=repr)
    assert got == sorted(((i, lib.encode(t or "")) for i, t in ROWS), key=repr)
    back = sorted((tuple(r) for r in pieces.decode(rows).collect()), key=repr)
    assert back == sorted(((i, lib.decode(lib.encode(t or ""))) for i, t in ROWS), key=repr)
    empty = docs.limit(0)
    assert pieces.encode(empty).collect() == [] == pieces.digests(empty).collect() == pieces.decode(rows.limit(0)).collect()


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    lib = MODELS["own"].lib
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = lib.encode(r.text or "")
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), len((r.text or "").encode())))
    assert sorted(map(tuple, pieces.op11_sentencepiece(spark, sf).collect())) == sorted(want)
