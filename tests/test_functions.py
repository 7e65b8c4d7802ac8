"""Pinned semantics of the column helpers (rounding, integer averages, day/month differences)."""

from __future__ import annotations

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from duck_oracle.sqlfn import DD, R
from feira.functions import (
    day_diff,
    int_div,
    lenient_timestamp,
    month_diff,
    ratio_pct_round,
    ratio_round,
    sample_stdev,
)


def test_ratio_round_half_up_and_zero_division(spark):
    row = spark.range(1).select(
        ratio_round(F.lit(1005), F.lit(1000), 2).alias("a"),
        ratio_round(F.lit(-1005), F.lit(1000), 2).alias("b"),
        ratio_round(F.lit(1), F.lit(0), 2).alias("c"),
        ratio_pct_round(F.lit(1), F.lit(3), 2).alias("d"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == (1.01, -1.01, None, 33.33)


def test_ratio_round_equals_oracle_on_many_ratios(spark):
    pairs = [(i, j) for i in range(-40, 41) for j in range(1, 41)]
    df = spark.createDataFrame(pairs, "i int, j int")
    got = {(r.i, r.j): (r.x, r.y) for r in df.select("i", "j", ratio_round("i", "j", 2).alias("x"),
                                                      ratio_round(F.col("i") * 100, "j", 3).alias("y")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, j INTEGER)")
    con.executemany("INSERT INTO t VALUES (?, ?)", pairs)
    want = {(i, j): (x, y) for i, j, x, y in con.sql(f"SELECT i, j, {R('i', 'j', 2)}, {R('i * 100', 'j', 3)} FROM t").fetchall()}
    assert got == want


def test_int_div_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-7, 2), (7, 2), (-3, 4), (3, 4), (5, 0)], "s long, n long")
    assert [r.q for r in df.select(int_div("s", "n").alias("q")).collect()] == [-3, 3, 0, 0, None]


def test_day_diff_counts_midnights(spark):
    rows = [(dt.datetime(2018, 1, 1, 23, 0), dt.datetime(2018, 1, 2, 1, 0)),
            (dt.datetime(2018, 1, 2, 1, 0), dt.datetime(2018, 1, 1, 23, 0)),
            (dt.datetime(2018, 1, 1, 0, 0), dt.datetime(2018, 1, 1, 23, 59))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r.d for r in df.select(day_diff("a", "b").alias("d")).collect()]
    assert got == [1, -1, 0]
    con = duckdb.connect()
    want = [con.sql(f"SELECT {DD(repr(str(a)) + '::timestamp', repr(str(b)) + '::timestamp')}").fetchall()[0][0]
            for a, b in rows]
    assert got == want


def test_month_diff_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(2018, 1, 31), dt.date(2018, 2, 1)), (dt.date(2017, 12, 1), dt.date(2018, 1, 1)),
                                (dt.date(2018, 3, 1), dt.date(2018, 3, 31))], "a date, b date")
    assert [r.m for r in df.select(month_diff("a", "b").alias("m")).collect()] == [1, 1, 0]


def test_lenient_timestamp(spark):
    df = spark.createDataFrame([("2018-01-02 03:04:05",), ("not-a-date",), (None,)], "s string")
    got = [r.t for r in df.select(lenient_timestamp("s").alias("t")).collect()]
    assert got == [dt.datetime(2018, 1, 2, 3, 4, 5), None, None]


def test_sample_stdev_from_moments(spark):
    df = spark.createDataFrame([(1, 5, 25), (2, 6, 20), (3, 6, 14)], "n long, s long, ss long")
    got = [r.sd for r in df.select(sample_stdev("n", "s", "ss").alias("sd")).collect()]
    assert got[0] is None
    assert abs(got[1] - 1.4142135623730951) < 1e-12  # values 2, 4
    assert abs(got[2] - 1.0) < 1e-12  # values 1, 2, 3
