import brute
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from pitwall.llm import licenses as L

MIT_LONG = next(t for i, t in L.TEMPLATES if i == "MIT" and 40 < len(t.split()) < 60)
DOCS = [
    (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore"), (2, "released UNDER the mit license"), (3, None), (4, ""),
    (5, "filler " * 9000 + MIT_LONG + " filler" * 500), (6, MIT_LONG.replace("restriction", "limits")), (7, " ".join(MIT_LONG.split()[:20])),
    (8, "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0."), (9, "licensed under the"),
    (10, "This work is licensed under the great General Public License, version 3."), (11, "nothing here " * 100), (12, (MIT_LONG + "\n") * 3),
    (13, "under the Apache License, Version 2.0. x Licensed under the Apache License"),
]


def frame(spark, docs=DOCS):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("limit", [0, 200_000])
def test_scan_equals_the_sql(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "MAX_BROADCAST", limit)
    want = brute.sql(L.OP10_SQL, documents=brute.documents([(*d, None, None) for d in DOCS]))
    assert brute.rows(L.scan(frame(spark), L.default_templates(spark))) == brute.rows(want)


def test_planted_licenses(spark):
    got = {(r["doc_id"], r["license"]) for r in L.scan(frame(spark), L.default_templates(spark)).collect()}
    assert {(1, "Apache-2.0"), (2, "MIT"), (5, "MIT"), (6, "MIT"), (8, "GPL-3.0"), (8, "CC-BY-NC-4.0"), (12, "MIT")} <= got
    assert not {i for i, _ in got} & {3, 4, 7, 9, 11}


def test_own_templates_repeated_rows_extra_columns_and_empty_tables(spark):
    own = spark.createDataFrame([(1, "X", "alpha beta gamma delta epsilon zeta"), (2, "Y", "too short"), (3, None, None)], "template_id int, license string, text string")
    docs = frame(spark, [(1, "w alpha beta gamma delta epsilon zeta w")] * 2 + [(None, "alpha beta gamma delta epsilon zeta")]).withColumn("license", F.lit("z")).withColumn("class", F.lit(3))
    assert sorted(map(tuple, L.scan(docs, own).collect()), key=repr) == sorted([(1, "X", 2, 2, 0), (None, "X", 2, 2, 0)], key=repr)
    assert L.scan(docs.limit(0), own).collect() == [] and L.scan(docs, own.limit(0)).collect() == []


def test_no_document_words_in_the_shingle_join(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST", 0)
    want = brute.rows(L.scan(frame(spark), L.default_templates(spark)))
    wide, join = [], DataFrame.join

    def spy(left, right, *args):
        if "_l_h" in left.columns:
            wide.extend(set(left.columns) - {"doc_id", "_l_text", "_l_p", "_l_h"})
        return join(left, right, *args)

    monkeypatch.setattr(DataFrame, "join", spy)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert brute.rows(L.scan(frame(spark), L.default_templates(spark))) == want and wide == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bands_lose_no_short_template_at_the_start_of_a_text(spark):
    n = 2000
    own = spark.range(n).selectExpr("int(id) template_id", "concat('L', id) license", "concat_ws(' ', transform(sequence(1, 5), k -> concat('t', id, 'x', k))) text")
    docs = own.selectExpr("bigint(template_id) doc_id", "concat(text, ' ', concat_ws(' ', transform(sequence(1, 10), k -> concat('f', template_id, 'x', k)))) text")
    assert {tuple(r) for r in L.scan(docs, own).collect()} == {(i, f"L{i}", 1, 1, 0) for i in range(n)}


def test_long_templates_of_every_class(spark):
    sizes = [5, 8, 9, 16, 17, 33, 64, 65, 129, 257, 513, 1025, 2049, 4097, 8193, 16385, 30000]
    own = [(i, f"L{n}", " ".join(f"w{n}x{k}" for k in range(n))) for i, n in enumerate(sizes)]
    text = [(i, "before " * (3 * i) + t + " after" * 7) for i, _, t in own]
    got = L.scan(frame(spark, text), spark.createDataFrame(own, "template_id int, license string, text string")).collect()
    assert {(r["doc_id"], r["license"], r["matched"], r["total"]) for r in got} == {(i, f"L{n}", n - 4, n - 4) for i, n in enumerate(sizes)}


def test_siblings_are_told_apart(spark):
    notice = "This work is licensed under the GNU General Public License, version {}."
    bsd = {i: t for i, t in L.TEMPLATES if i.startswith("BSD-") and len(t) > 600}
    rows = [(1, notice.format(2)), (2, notice.format(3)), (3, "text " * 30 + notice.format(2) + " words" * 60 + " " + notice.format(3)),
            (4, "Licensed under CC BY 4.0."), (5, "Licensed under CC BY-SA 4.0."), (6, "Licensed under CC BY-NC 4.0."),
            (7, bsd["BSD-2-Clause"]), (8, bsd["BSD-3-Clause"]), (9, next(t for i, t in L.TEMPLATES if i == "ISC"))]
    got = {}
    for r in L.scan(frame(spark, rows), L.default_templates(spark)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got[1] == {"GPL-2.0"} and got[2] == {"GPL-3.0"} and got[3] == {"GPL-2.0", "GPL-3.0"}
    assert got[4] == {"CC-BY-4.0"} and got[5] == {"CC-BY-SA-4.0"} and got[6] == {"CC-BY-NC-4.0"}
    assert got[7] == {"BSD-2-Clause"} and got[8] == {"BSD-3-Clause"} and got[9] == {"ISC"}


def test_twenty_licenses_are_found_in_their_own_templates(spark):
    rows = [(k, "Some words before. " + t + " And some words after it.") for k, (_, t) in enumerate(L.TEMPLATES)]
    got = {(r["doc_id"], r["license"]) for r in L.scan(frame(spark, rows), L.default_templates(spark)).collect()}
    assert len({i for i, _ in L.TEMPLATES}) >= 20 and {(k, i) for k, (i, _) in enumerate(L.TEMPLATES)} <= got
