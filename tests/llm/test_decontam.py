import itertools

import brute
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from pitwall.llm import decontam as D


def test_masks_find_any_window_with_two_substitutions():
    for errors in itertools.combinations(range(D.WINDOW), 2):
        assert any(
            all(p + o not in errors for o in m) for m in D.MASKS for p in range(D.WINDOW - D.SPAN + 1)
        ), errors
    assert all(max(m) < D.SPAN for m in D.MASKS)


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix potions in the old stone tower"
T = ITEM.split()


def swap(*at):
    return " ".join("zzz" if i in at else w for i, w in enumerate(T))


DOCS = [
    (1, f"before {ITEM} after", "en", "a"), (2, f"x y {swap(2, 9, 16)} z", "en", "a"), (3, swap(*range(0, 20, 3)), "en", "a"),
    (4, None, None, None), (5, "", "en", "a"), (6, " ".join(T[:13]).upper() + "!", "en", "a"), (7, " ".join(T[:12]), "en", "a"),
    (8, " ".join(T[5:]) + " " + " ".join(T), "en", "a"), (9, "eight tokens item that is rather short here", "en", "a"),
    (10, "nothing of this kind " * 300, "en", "a"), (11, "the of and in to a is it " * 50, "en", "a"), (12, "é " + ", ".join(T), "en", "a"),
    (13, "filler " * 20000 + ITEM, "en", "a"),
]
ITEMS = [(1, ITEM), (2, "eight tokens item that is rather short here"), (3, "too short to tell"), (4, None), (5, ""), (6, "the of and in to a is it the of"), (1, ITEM)]


def frames(spark, docs=DOCS, items=ITEMS):
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def found(spark, docs, items):
    return D.leaks(docs, items).select("doc_id", "item_id", "start", "matched")


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_leaks_equal_the_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_BROADCAST", limit)
    want = brute.sql(D.OP6_SQL, documents=brute.documents(DOCS), benchmark=pd.DataFrame(ITEMS, columns=["item_id", "text"]))
    assert brute.rows(found(spark, *frames(spark))) == brute.rows(want)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    got = {(r["doc_id"], r["item_id"]): r for r in found(spark, *frames(spark)).collect()}
    assert {i for i, j in got if j == 1} == {1, 2, 6, 8, 12, 13}  # 7: twelve tokens of a longer item
    assert got[1, 1]["start"] == 1 and got[13, 1]["start"] == 20000 and (9, 2) in got


def test_drop_keeps_clean_rows_nulls_and_columns(spark):
    docs, items = frames(spark, DOCS + [(10, DOCS[9][1], "en", "a"), (None, ITEM, "en", "a"), (None, "clean", "en", "a"), (1, "clean text of id one", "en", "a")])
    docs = docs.withColumn("item_id", F.lit(1)).withColumn("start", F.lit("s"))
    kept = D.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept.collect()) == sorted(
        [(3, DOCS[2][1][:5]), (4, ""), (5, ""), (7, "The q"), (10, "nothi"), (10, "nothi"), (0, "clean"), (1, "clean")]
    )


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.leaks(docs.limit(0), items).collect() == [] and D.leaks(docs, items.limit(0)).collect() == []
    assert D.drop_leaks(docs, items.limit(0)).count() == len(DOCS)


def test_short_masks_find_every_substitution_that_the_verifier_accepts():
    for n in range(1, D.WINDOW):
        errors = n * (100 - D.MIN_SHARE) // 100 if n >= D.SPAN else 0
        for at in itertools.combinations(range(n), errors):
            assert any(not set(m) & set(at) for m in D.short_masks(n)), (n, at)
        assert all(0 <= o < n for m in D.short_masks(n) for o in m)


def test_short_items_are_found_with_every_substitution(spark):
    items = [(n, " ".join(f"t{n}x{i}" for i in range(n))) for n in range(1, 13)]
    docs, want = [], set()
    for n, text in items:
        for k in range(4):
            for at in itertools.combinations(range(n), k):
                words = [f"zzz{i}" if i in at else w for i, w in enumerate(text.split())]
                docs.append((len(docs), f"before it {' '.join(words)} after", "en", "a"))
                if k == 0 or (n >= 8 and 100 * (n - k) >= D.MIN_SHARE * n):
                    want.add((docs[-1][0], n, 2, n - k))
    docs.append((len(docs), items[9][1][:-5], "en", "a"))  # the item doesn't end in it
    assert set(map(tuple, found(spark, *frames(spark, docs, items)).collect())) == want
    docs, items = frames(spark, [(1, "Was it him? Yes.", "en", "a"), (2, "yes it was", "en", "a")], [(1, "it was"), (2, "YES"), (3, "was it yes")])
    assert sorted(map(tuple, found(spark, docs, items).collect())) == [(1, 2, 3, 1), (2, 1, 1, 2), (2, 2, 0, 1)]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_no_document_tokens_in_the_seed_join(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_BROADCAST", limit)
    want = brute.rows(found(spark, *frames(spark)))
    wide, join = [], DataFrame.join

    def spy(left, right, *args):
        if "_d_h" in left.columns:
            wide.extend(set(left.columns) - {"doc_id", "_d_text", "_d_p", "_d_h"})
        return join(left, right, *args)

    monkeypatch.setattr(DataFrame, "join", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert brute.rows(found(spark, *frames(spark))) == want and wide == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
