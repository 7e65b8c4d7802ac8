"""Operator 7: held-out accuracy, rejection and the defined cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feira.llm import langid
from feira.llm.queries import op7_language_id

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.train(docs, train_on=F.col("doc_id") % 2 == 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = op7_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right >= 0.97 * n


def test_training_is_repeatable(spark, model):
    again = langid.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), train_on=F.col("doc_id") % 2 == 0)
    assert again.languages == model.languages
    assert (again.centroids == model.centroids).all()


def test_defined_cases(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 !? 45", "x"), (4, "the", "x"), (None, "und der die das", "x"), (6, "qzx jjq vvk wqq zzx kkj qqv xxz " * 20, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df, model, {"doc_id": "doc_id", "lang_pred": "before"}).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred in model.languages and 0 <= got[4].score <= 1
    assert got[None].lang_pred == "de" and got[None].before == "x"
    assert got[6].rejected


def test_no_clean_document_is_rejected(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 1")
    assert langid.identify(docs, model, {"doc_id": "doc_id"}).where("rejected").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    nothing = langid.train(empty, train_on=F.lit(True))
    assert langid.identify(empty, nothing, {"doc_id": "doc_id"}).count() == 0
    got = langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), nothing, {"doc_id": "doc_id"}).first()
    assert got.lang_pred == "und" and got.rejected
