"""Operator 3 against all inner products."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from feira.llm.topk import top_k


def brute(rows, k, scale, every):
    sound = [(i, x) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    items = [(i, [math.floor(scale * v) for v in x]) for i, x in sound]
    out = []
    for at, (q, w) in enumerate(items):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, c)), i) for other, (i, c) in enumerate(items) if other != at)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def result(df, k, scale, every, **blocks):
    found = top_k(df, F.col("vec_id") % every == 0, k=k, scale=scale, **blocks)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 40, "query_block": 8}])
def test_against_all_products(spark, rng, blocks):
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1), 0.5]) for _ in range(8)]) for i in range(150)]
    rows += [(200, None), (201, [None] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [0.0] * 7), (204, []), (205, [1.0, 1.0]), (206, [0.0] * 8), (None, [1.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    single = [(i, None if x is None else [None if v is None else float(v) for v in x]) for i, x in ((r.vec_id, r.embedding) for r in df.collect())]
    assert result(df, 20, 64.0, 5, **blocks) == brute(single, 20, 64.0, 5)


def test_ties_and_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (0, 7, 3, 20)], "vec_id long, embedding array<double>")
    assert result(df, 20, 64.0, 20) == [(0, 1, 3, 4096), (0, 2, 7, 4096), (0, 3, 20, 4096), (20, 1, 0, 4096), (20, 2, 3, 4096), (20, 3, 7, 4096)]
    assert result(df.where("vec_id = 0"), 20, 64.0, 20) == []


def test_rows_of_one_id_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [3.0, 0.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(df, 20, 64.0, 20) == [(20, 1, 1, 12288), (20, 2, 1, 4096)]
    df = spark.createDataFrame([(20, [1.0, 0.0]), (20, [2.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert result(df, 20, 64.0, 20) == [(20, 1, 3, 8192), (20, 1, 20, 8192), (20, 2, 3, 4096), (20, 2, 20, 8192)]


@pytest.mark.parametrize("blocks", [{}, {"candidate_block": 40, "query_block": 8}])
def test_a_row_repeated_very_often(spark, rng, blocks):
    rows = [(40, [0.5, 0.25])] * 120 + [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert result(df, 20, 64.0, 20, **blocks) == brute(rows, 20, 64.0, 20)


def test_large_weights(spark):
    rows = [(i, [float(2**20 + i), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(df, 5, 64.0, 20) == brute(rows, 5, 64.0, 20)
    huge = [(i, [float(2**23 - i), float(2**22 + i)]) for i in range(60)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    assert result(df, 5, 64.0, 20) == brute(huge, 5, 64.0, 20)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "vec_id long, embedding array<float>"), 20, 64.0, 20) == []
