"""Incremental refresh: only added or changed files are read, and the result equals a full build."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from feira.sources.csv_io import read_csv_files
from feira.sources.increments import PAYMENTS, _listing, _store, compact, merged, refresh
from tests.compare import assert_same

HEADER = "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
FIRST = "o1,1,card,3,10.50\no1,2,card,3,1.25\no2,1,boleto,1,7.00\n"
SECOND = "o1,1,card,3,2.00\no3,1,,,\no3,1,,,\n,1,card,1,0.10\n"


def put(folder, name: str, rows: str) -> None:
    (folder / name).write_text(HEADER + rows)


def names(paths: list[str]) -> list[str]:
    return [os.path.basename(p) for p in paths]


def check(spark, folder) -> None:
    """The merged partials equal one aggregation over all files."""
    got = merged(spark, PAYMENTS, str(folder))
    rows = read_csv_files(spark, [str(folder)], "order_payments")
    want = rows.groupBy("order_id", "payment_type", "payment_installments").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("payment_value").alias("value_sum"), F.count("payment_value").alias("value_n"))
    as_text = [F.col(c).cast("string") for c in want.columns]
    assert_same(got.select(*as_text).toPandas(), want.select(*as_text).toPandas(), str(folder))


def test_an_added_file_reads_only_itself(spark, tmp_path):
    put(tmp_path, "a.csv", FIRST)
    assert names(refresh(spark, PAYMENTS, str(tmp_path))) == ["a.csv"]
    put(tmp_path, "b with space.csv", SECOND)
    put(tmp_path, "empty.csv", "")
    assert names(refresh(spark, PAYMENTS, str(tmp_path))) == ["b with space.csv", "empty.csv"]
    assert refresh(spark, PAYMENTS, str(tmp_path)) == []
    check(spark, tmp_path)


def test_changed_and_deleted_files(spark, tmp_path):
    put(tmp_path, "a.csv", FIRST)
    put(tmp_path, "b.csv", SECOND)
    check(spark, tmp_path)
    put(tmp_path, "a.csv", FIRST + SECOND)
    assert names(refresh(spark, PAYMENTS, str(tmp_path))) == ["a.csv"]
    check(spark, tmp_path)
    put(tmp_path, "a.csv", "")
    check(spark, tmp_path)


def test_a_deleted_file_drops_out(spark, tmp_path):
    folder, other = tmp_path / "in", tmp_path / "other"
    folder.mkdir()
    other.mkdir()
    put(folder, "a.csv", FIRST)
    put(folder, "b.csv", SECOND)
    check(spark, folder)
    os.rename(folder / "a.csv", other / "a.csv")
    assert refresh(spark, PAYMENTS, str(folder)) == []
    check(spark, folder)


def test_compaction_reads_no_source(spark, tmp_path):
    put(tmp_path, "a.csv", FIRST)
    refresh(spark, PAYMENTS, str(tmp_path))
    put(tmp_path, "b.csv", SECOND)
    check(spark, tmp_path)
    compact(spark, PAYMENTS, str(tmp_path))
    rows = _store(spark, PAYMENTS, str(tmp_path)).removeprefix("file:") + "/rows"
    assert len(os.listdir(rows)) == 1
    assert refresh(spark, PAYMENTS, str(tmp_path)) == []
    check(spark, tmp_path)


def test_an_unlisted_batch_and_a_second_batch_of_a_file(spark, tmp_path):
    """What a refresh left that was ended early doesn't count; of two refreshes at the same time one does."""
    put(tmp_path, "a.csv", FIRST)
    refresh(spark, PAYMENTS, str(tmp_path))
    store, path = _store(spark, PAYMENTS, str(tmp_path)), str(tmp_path / "a.csv")
    again = PAYMENTS.of_files(spark, [path])
    again.write.parquet(f"{store}/rows/__batch=b99-unlisted")
    check(spark, tmp_path)
    again.write.parquet(f"{store}/rows/__batch=b98-twice")
    _listing(spark, path).select("__source_file").write.parquet(f"{store}/files/__batch=b98-twice")
    check(spark, tmp_path)


def test_no_files(spark, tmp_path):
    with pytest.raises(ValueError, match="no files"):
        refresh(spark, PAYMENTS, str(tmp_path))
