"""Profiles merged from files equal those of the whole table."""

import os

import pytest

from pitwall.operators import validate as V
from pitwall.sources import profiles as P

SCHEMA = ("id_number string, average_corrosion_rate double, thickness_mm double, commodity string, feature_type string, "
          "cml_shape string")
FIRST = [("A", 0.1, 8.0, "Gas", "Pipe", "Both"), ("B", None, 7.5, None, "Tee", "Both"), ("A", 0.3, 2.5, "Gas", None, "Both")]
SECOND = [("B", float("nan"), 9.0, "Steam", "Tee", None), ("C", 0.2, None, "Gas", "Pipe", "Both"), (None, 0.4, 1.0, "Gas", "Pipe", None),
          (None, 0.5, 1.5, "Gas", "Pipe", "Both")]


def _file(spark, rows, path):
    """One parquet file of that name (a % and a + in it have to survive)."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return next(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet"))


def _same(spark, base, rows):
    whole = V.normalise(spark.createDataFrame(rows, SCHEMA))
    for merged, direct in ((P.dataset_profile(spark, base), V.dataset_profile(whole)),
                           (P.duplicate_ids(spark, base), V.duplicate_ids(whole)), (P.null_counts(spark, base), V.null_counts(whole))):
        assert merged.dtypes == direct.dtypes
        assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, direct.collect()))
    assert P.approx_ids(spark, base).first()[0] == len({r[0] for r in rows} - {None})


def test_adding_a_file_reads_only_that_file(spark, scratch):
    folder, base = f"{scratch}/in", f"{scratch}/profiles"
    one = _file(spark, FIRST, f"{folder}/a 1%+")
    assert len(P.refresh(spark, folder, base)) == 1
    _same(spark, base, FIRST)
    assert P.refresh(spark, folder, base) == []
    info = os.stat(one)  # the first file can't be read any more
    with open(one, "wb") as f:
        f.write(b"x" * info.st_size)
    os.utime(one, ns=(info.st_atime_ns, info.st_mtime_ns))
    _file(spark, SECOND, f"{folder}/b")
    assert len(P.refresh(spark, folder, base)) == 1
    _same(spark, base, FIRST + SECOND)


def test_rewritten_deleted_and_empty_files(spark, scratch):
    folder, base = f"{scratch}/in", f"{scratch}/profiles"
    one = _file(spark, FIRST, f"{folder}/a")
    two = _file(spark, SECOND, f"{folder}/b")
    P.refresh(spark, folder, base)
    os.replace(_file(spark, SECOND[:2], f"{scratch}/other"), one)  # rewritten
    os.remove(f"{os.path.dirname(one)}/.{os.path.basename(one)}.crc")
    assert len(P.refresh(spark, folder, base)) == 1
    _same(spark, base, SECOND[:2] + SECOND)
    os.remove(two)
    assert P.refresh(spark, folder, base) == []
    _same(spark, base, SECOND[:2])
    _file(spark, [], f"{folder}/none")
    P.refresh(spark, folder, base)
    _same(spark, base, SECOND[:2])


def test_crash_before_the_marker_changes_nothing(spark, scratch, monkeypatch):
    folder, base = f"{scratch}/in", f"{scratch}/profiles"
    _file(spark, FIRST, f"{folder}/a")
    P.refresh(spark, folder, base)
    _file(spark, SECOND, f"{folder}/b")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(P, "commit", crash)
        with pytest.raises(RuntimeError):
            P.refresh(spark, folder, base)
    _same(spark, base, FIRST)
    assert len(P.refresh(spark, folder, base)) == 1
    _same(spark, base, FIRST + SECOND)


def test_nothing_profiled(spark, scratch):
    assert P.dataset_profile(spark, f"{scratch}/none").first().total_records == 0
    assert P.duplicate_ids(spark, f"{scratch}/none").first().n_duplicates == 0
    assert P.null_counts(spark, f"{scratch}/none").isEmpty()
