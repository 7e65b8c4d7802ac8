"""The distributed ranking operator against Spark's built-in global windows (brute force on small data)."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.operators.ranking import RankOut, with_global_ranks
from feira.operators.selection import tiebreak_hash


def _brute(df, key, column, ascending, kind, n=None):
    value = F.col(column).asc_nulls_first() if ascending else F.col(column).desc_nulls_last()
    if kind == "rank":
        return F.rank().over(W.orderBy(value))
    order = W.orderBy(value, tiebreak_hash(key).asc_nulls_first(), F.col(key).asc_nulls_first())
    return F.ntile(n).over(order) if kind == "ntile" else F.row_number().over(order)


def _check(spark, rows, schema, column, cuts):
    df = spark.createDataFrame(rows, schema)
    outs = [
        RankOut("rk_a", column, True, "rank"),
        RankOut("rk_d", column, False, "rank"),
        RankOut("rn_a", column, True, "row_number"),
        RankOut("rn_d", column, False, "row_number"),
        RankOut("nt5_a", column, True, "ntile", 5),
        RankOut("nt5_d", column, False, "ntile", 5),
        RankOut("nt4_d", column, False, "ntile", 4),
    ]
    got = with_global_ranks(df, "id", outs, cuts=cuts)
    want = df.select(
        "id",
        *[_brute(df, "id", o.column, o.ascending, o.kind, o.n).alias(o.name) for o in outs],
    )
    g = {r.id: tuple(r[o.name] for o in outs) for r in got.collect()}
    w = {r.id: tuple(r[o.name] for o in outs) for r in want.collect()}
    assert g == w


@pytest.mark.parametrize("cuts", [1, 3, 127, None])
def test_skewed_ties_and_nulls(spark, cuts):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        r = rng.random()
        if r < 0.34:
            v = 10  # one value held by a third of the rows
        elif r < 0.40:
            v = None
        else:
            v = rng.randint(0, 60)
        rows.append((i, v))
    _check(spark, rows, "id long, v long", "v", cuts)


def test_decimal_money_values(spark):
    rng = random.Random(11)
    rows = [(i, Decimal(rng.choice([1999, 5000, 5000, 123456, rng.randint(1, 10**7)])) / 100) for i in range(500)]
    _check(spark, rows, "id long, v decimal(20,2)", "v", 31)


@pytest.mark.parametrize("n_rows", [1, 3, 7])
def test_fewer_rows_than_tiles(spark, n_rows):
    _check(spark, [(i, i % 2) for i in range(n_rows)], "id long, v long", "v", 127)


def test_all_values_equal(spark):
    _check(spark, [(i, 5) for i in range(300)], "id long, v long", "v", 15)


def test_double_with_nulls(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 17 == 0 else round(rng.uniform(0, 5), 2)) for i in range(400)]
    _check(spark, rows, "id long, v double", "v", 63)


def test_ntile_group_sizes_differ_by_at_most_one(spark):
    df = spark.createDataFrame([(i, i % 13) for i in range(1003)], "id long, v long")
    sizes = (with_global_ranks(df, "id", [RankOut("t", "v", False, "ntile", 5)])
             .groupBy("t").count().orderBy("t").collect())
    counts = [r["count"] for r in sizes]
    assert [r.t for r in sizes] == [1, 2, 3, 4, 5]
    assert max(counts) - min(counts) <= 1 and counts == sorted(counts, reverse=True)


def test_exact_quantiles_match_percentile(spark):
    from feira.operators import quantiles

    rng = random.Random(5)
    rows = [(None if i % 23 == 0 else float(rng.choice([1, 2, 2, 2, 3, rng.randint(0, 1000)])),) for i in range(777)]
    df = spark.createDataFrame(rows, "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r.p: r.value for r in quantiles.exact_quantiles(df, "x", probs).collect()}
    want = df.agg(F.percentile("x", probs).alias("q")).first().q
    for p, w in zip(probs, want):
        assert abs(got[p] - w) < 1e-9, (p, got[p], w)


def test_exact_quantiles_of_empty_column(spark):
    from feira.operators import quantiles

    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r.value for r in quantiles.exact_quantiles(df, "x", [0.5]).collect()] == [None]


def test_property_random_inputs(spark):
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    values = st.lists(st.one_of(st.none(), st.integers(min_value=-5, max_value=5)), min_size=1, max_size=60)

    @settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
    @given(values, st.sampled_from([1, 2, 7]))
    def check(vs, cuts):
        _check(spark, list(enumerate(vs)), "id long, v long", "v", cuts)

    check()


def test_exact_quantiles_many_columns_with_nulls(spark):
    from feira.operators import quantiles

    rng = random.Random(9)
    rows = [(None if i % 5 == 0 else rng.randint(0, 50), None if i % 3 == 0 else rng.random() * 10, None)
            for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c double")
    probs = [0.25, 0.5, 0.75]
    got = {(r.column_name, r.p): r.value for r in quantiles.exact_quantiles_many(df, ["a", "b", "c"], probs).collect()}
    for col in ("a", "b"):
        want = df.agg(F.percentile(col, probs).alias("q")).first().q
        for p, w in zip(probs, want):
            assert abs(got[(col, p)] - w) < 1e-9, (col, p)
    assert all(got[("c", p)] is None for p in probs)


@pytest.mark.parametrize("rows,per_class", [(4000, 100), (32000, 100)])
def test_rows_per_group_stay_bounded(spark, monkeypatch, rows, per_class):
    """Eight times the rows give more groups, not larger ones; a value of a third of the rows and NULLs are split too."""
    from feira.operators import ranking, selection

    monkeypatch.setattr(selection, "ROWS_PER_CLASS", per_class)
    df = spark.range(rows).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).cast("long").alias("v"))
    seen = []
    real = ranking.materialize

    def watch(frame):
        out = real(frame)
        if "cls" in out.columns:
            seen.append(out.agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ranking, "materialize", watch)
    got = with_global_ranks(df, "id", [RankOut("t", "v", True, "ntile", 5), RankOut("n", "v", True, "row_number")])
    assert sorted(r["count"] for r in got.groupBy("t").count().collect()) == [rows // 5] * 5
    assert got.where(F.col("t") != F.floor((F.col("n") - 1) / (rows // 5)) + 1).isEmpty()
    assert seen and max(seen) <= 8 * per_class


def test_tiles_shuffle_no_rows(spark):
    """The plan of the tiles is a scan of the checkpoint and comparisons, whatever the ties."""
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("v"), F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("w"))
    got = with_global_ranks(df, "id", [RankOut("a", "v", False, "ntile", 5), RankOut("b", "w", True, "ntile", 4), RankOut("c", "w", False, "ntile", 7)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Join" not in plan


@pytest.mark.parametrize("per_class", [20, 200_000])
def test_tiles_among_ties_of_many_prefixes(spark, monkeypatch, per_class):
    """Boundaries inside a value that most rows hold, found by prefixes of the tie-break hash."""
    from feira.operators import selection

    monkeypatch.setattr(selection, "ROWS_PER_CLASS", per_class)
    rows = [(i, None if i % 4 == 0 else 1 if i % 9 else i) for i in range(1, 2000)]
    _check(spark, rows, "id long, v long", "v", 5)


def test_few_cuts_still_give_exact_quantiles(spark, monkeypatch):
    """A sample of a few rows only moves the cuts."""
    from feira.operators import quantiles, selection

    monkeypatch.setattr(selection, "SAMPLE_PER_CUT", 1)
    monkeypatch.setattr(selection, "ROWS_PER_CLASS", 700)
    df = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) / 7.0).alias("x"))
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r.p: r.value for r in quantiles.exact_quantiles(df, "x", probs).collect()}
    assert list(got.values()) == pytest.approx(df.agg(F.percentile("x", probs).alias("q")).first().q)
