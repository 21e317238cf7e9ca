import brute
import pytest

from pitwall.llm import rules

W = " ".join(f"w{i}" for i in range(30))
ROWS = [
    (1, W, "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, "one two", None, "a"),
    (5, " ".join(["a b c d e f g h"] * 4), "en", "a"), (6, "x " * 40, "en", "b"), (7, f"{W}\n{W}\nother line\n\n \n{W}", "de", "a"),
    (8, "### $$ " + W + " <a|b>", "en", "a"), (9, W, "en", "a"), (9, W, "en", "a"), (10, "a\tb\x0bc\r\nd\x1c e " + W, "en", "a"),
    (11, "é ü " + W, "fr", "a"), (12, "word " * 5000 + W, "en", "a"), (None, W, "en", "a"), (13, W.upper(), "en", "a"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("min_docs", [1, 100])
def test_counts_and_verdicts_equal_the_sql(spark, monkeypatch, min_docs):
    monkeypatch.setattr(rules, "MIN_DOCS", min_docs)
    query = rules.OP3_SQL.replace(">= 100 THEN", f">= {min_docs} THEN")
    rows = [(k, *r[1:]) for k, r in enumerate(ROWS)]  # the SQL joins by id
    assert brute.rows(rules.quality_rules(frame(spark, rows))) == brute.rows(brute.sql(query, documents=brute.documents(rows)))


def test_shuffle_join_gives_the_same(spark, monkeypatch):
    one = brute.rows(rules.quality_rules(frame(spark, ROWS)))
    monkeypatch.setattr(rules, "MAX_BROADCAST_GROUPS", 0)
    assert brute.rows(rules.quality_rules(frame(spark, ROWS))) == one


def test_repeated_words_by_hand(spark):
    def brute_force(text):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        return len({i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(8)})

    texts = [" ".join(["a b c d e f g h"] * 3) + " x " + "a b c d e f g h", "a " * 9, "a " * 8, "a " * 7, "q w e " * 9 + "z"]
    got = rules.with_counts(spark.createDataFrame([(t,) for t in texts], "text string")).select("text", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in got} == {t: brute_force(t) for t in texts}


def test_clean_stay_and_junk_goes_per_group(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(110)]
    shouting = [(300 + i, " ".join(f"word{j}#$$$" for j in range(60)), "en", "s") for i in range(6)]
    symbols = [(400 + i, " ".join(f"a{i}b{j}=$#|" for j in range(60)), "en", "code") for i in range(120)]  # usual there
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(frame(spark, clean + shouting + symbols)).collect()}
    assert all(got[i] for i in range(110)) and not any(got[300 + i] for i in range(6)) and all(got[400 + i] for i in range(120))


def test_fences_adapt_to_their_group(spark):
    """Two groups whose fences differ for every ratio; what is usual in one is rejected in the other."""

    def text(k, i, per_line, upper, symbol, again, size):
        w = [f"{'W' if j % upper == 0 else 'w'}{'x' * size}{k}{i}n{j}{'#' if j % symbol == 0 else ''}" for j in range(60)]
        lines = [" ".join(w[j : j + per_line]) for j in range(0, 60, per_line)]
        return "\n".join(lines + lines[:again])

    noisy = [(i, text("a", i, 4 + i % 2, 3, 4 + i % 9, i % 3, 4 + i % 5), "en", "noisy") for i in range(120)]
    plain = [(500 + i, text("b", i, 6, 40, 50 + i % 9 if i % 4 == 0 else 99, int(i % 30 == 0), 2), "en", "plain") for i in range(120)]
    odd = [(900, text("c", 1, 4, 3, 5, 3, 8), "en", "plain")]
    counted = rules.with_counts(frame(spark, noisy + plain + odd))
    limits = {r["_q_source"]: r.asDict() for r in rules.thresholds(rules.sketches(counted)).collect()}
    for m in rules.RATIOS:
        assert limits["noisy"][f"_q_hi_{m}"] != limits["plain"][f"_q_hi_{m}"], m
    got = {r["doc_id"]: r["kept"] for r in rules.quality_rules(frame(spark, noisy + plain + odd)).collect()}
    assert not got[900] and sum(got[i] for i in range(120)) >= 110 and sum(got[500 + i] for i in range(120)) >= 110


def test_filter_passes_columns_through_and_empty_tables(spark):
    docs = frame(spark, ROWS).selectExpr("*", "doc_id AS n_words", "text AS kept", "1 AS bucket")
    out = rules.filter_documents(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert kept.count(9) == 2 and 2 not in kept and 1 in kept
    assert rules.filter_documents(docs.limit(0)).collect() == []
