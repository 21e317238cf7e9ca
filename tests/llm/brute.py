"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import zlib

import duckdb
import numpy as np
import pandas as pd
import xxhash


def sql(query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(f"_{name}", rows)
        con.execute(f"create table {name} as select * from _{name}")
    return con.sql(query)


def rows(relation_or_df):
    """Columns by name, rows as a sorted list."""
    if hasattr(relation_or_df, "collect"):
        names, got = relation_or_df.columns, [tuple(r) for r in relation_or_df.collect()]
    else:
        names, got = relation_or_df.columns, relation_or_df.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(r[i] for i in order) for r in got], key=repr)


def documents(rows):
    """A pandas frame of (doc_id, text, lang, source)."""
    return pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def simhash_classes(docs):
    """[(doc_id, fingerprint, component)] of (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        r = find(a)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, f"{p:016x}", least[find(a)]) for a, ((i, _), p) in enumerate(zip(docs, prints))]


def suffix_masks(texts):
    """Removed bytes of each text, texts in document order."""
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        mask = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            k = raw[s : s + 100]
            if k in seen:
                mask[s : s + 100] = True
            seen.add(k)
        out.append((raw, mask))
    return out


def suffix_digest(raw, mask):
    starts = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
    return len(raw), int(mask.sum()), starts, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~mask])).hexdigest()


def token_ids(texts):
    from tokenizers import Tokenizer

    from pitwall.llm import tokens

    tok = Tokenizer.from_file(tokens.byte_bpe_path())
    tok.encode_special_tokens = True
    return [np.array(e.ids + [0], "<u4") for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(pieces, docs, size=1024):
    """Every id lies in exactly one piece, sequences are gapless; returns padding and tokens."""
    ids = dict(zip([i for i, _ in docs], token_ids([t for _, t in docs])))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(ids[i][at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids[i])
    padding = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, total
