"""Operator 8: targets, takes, shards, and that Spark's plan holds no Python."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from feira.llm.mixing import mix_sources, shuffled_copies

SF = "/root/testdata/sf0.1"


def targets(sizes: dict, weights, share, most):
    """Weighted shares with the excess over the caps shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, free, out = share * sum(sizes.values()), set(order), {}
    while True:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * sizes[s]} if free else set()
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
            rest -= out[s]
        free -= over


@pytest.fixture(scope="module")
def mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("source") != "src7", F.col("source")))
    return mix_sources(docs), docs


def test_targets_and_takes(mixed):
    rows = mixed[0].select("doc_id", "text", "source", "mix_size", "mix_total", "mix_target", "mix_copies").collect()
    assert all(r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    sizes, takes, seen = {}, {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        takes[r.source] = takes.get(r.source, 0) + r.mix_size * r.mix_copies
        seen[r.source] = (r.mix_total, r.mix_target)
        assert 0 <= r.mix_copies <= 2
    want = targets(sizes, (5, 2, 1), 1.5, 2)
    for s in sizes:
        assert seen[s][0] == sizes[s] and seen[s][1] == pytest.approx(want[s])
        assert abs(takes[s] - want[s]) <= 0.01 * want[s]


def test_copies_are_dealt_to_the_shards(mixed):
    df, _ = mixed
    rows = df.select("source", "mix_copies", "mix_copy_shards").collect()
    assert all(len(r.mix_copy_shards) == r.mix_copies and all(0 <= s < 16 for s in r.mix_copy_shards) for r in rows)
    used = [s for r in rows for s in r.mix_copy_shards]
    counts = [used.count(s) for s in range(16)]
    assert min(counts) > 0.5 * max(counts)


def test_reruns_agree(mixed, spark):
    df, docs = mixed
    again = mix_sources(docs.repartition(7))
    a, b = ({r.doc_id: (r.mix_copies, r.mix_copy_shards) for r in x.select("doc_id", "mix_copies", "mix_copy_shards").collect()} for x in (df, again))
    assert a == b


def test_shuffled_copies(mixed):
    df, docs = mixed
    out = shuffled_copies(df, docs.columns)
    assert out.columns == docs.columns
    assert out.count() == df.agg(F.sum("mix_copies")).first()[0]


def test_a_shard_is_more_than_one_task(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame([(i, f"w{i} x", "a") for i in range(400)], "doc_id long, text string, source string")
        mixed = mix_sources(docs, shards=1)
        out = shuffled_copies(mixed, docs.columns).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(out) > 1 and max(r["count"] for r in out) < sum(r["count"] for r in out)


def test_no_python_in_the_plan(mixed):
    plan = mixed[0]._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_defined_cases(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "w " * 40, None, 1), (4, "x y", "b", 1), (4, "x y", "b", 1), (None, "z", "b", 1), (5, "q " * 10, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mix_sources(df)
    assert got.count() == len(rows) and "target" in got.columns
    sizes = {r.source: r.mix_total for r in got.collect()}
    assert sizes == {"a": 10, "b": 5, None: 40}
    assert got.where("doc_id = 4").select("mix_copies").distinct().count() == 1
    assert mix_sources(df.where("doc_id < 0")).count() == 0
    only = mix_sources(df.where("doc_id <= 2"))
    assert {r.mix_target for r in only.collect()} == {0.0}


def test_a_source_at_its_cap_gives_no_third_copy(spark):
    """Nothing remains behind the last pass, so not even empty documents are taken again."""
    rows = [(i, "word " * (i % 5), "s") for i in range(500)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=3.0).collect()
    assert {r.mix_copies for r in got} == {2}
