"""Data-quality profiling (the notebook's inspection cells) as tidy DataFrames.

Every profile is a Spark job over the whole table that returns a small
DataFrame (one row per column, table or group); nothing is printed and
nothing is collected. Per-column statistics are computed in one aggregation
over all columns and then unpivoted, never one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feira.functions import round_double
from feira.operators.quantiles import exact_quantiles_many

QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_NAMES = ("p25", "p50", "p75")


def _unpivot_row(agg: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """One-row aggregate with one column per input column -> (column_name, ordinal, value)."""
    return agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("ordinal"), F.col(f"`{n}`").alias(value))
                    for i, n in enumerate(names)
                ]
            )
        ).alias("u")
    ).select("u.*")


def _type_of(df: DataFrame) -> Column:
    """Declared type name per column, looked up by ``column_name``."""
    pairs = []
    for f in df.schema.fields:
        pairs += [F.lit(f.name), F.lit(f.dataType.simpleString())]
    return F.element_at(F.create_map(*pairs), F.col("column_name"))


def shape(df: DataFrame, table: str) -> DataFrame:
    """P-01 ``df.shape``: (table, n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(table).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
    )


def info(df: DataFrame) -> DataFrame:
    """P-02/P-03 ``df.info()``: per column its position, non-null count and declared type."""
    agg = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _unpivot_row(agg, df.columns, "non_null_count").withColumn("dtype", _type_of(df))


def null_counts(df: DataFrame) -> DataFrame:
    """P-04 ``isnull().sum()`` per column."""
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _unpivot_row(agg, df.columns, "null_count")


def distinct_counts(df: DataFrame, approximate: bool = False, rsd: float = 0.01) -> DataFrame:
    """P-05/P-06 ``nunique()`` per column (NULL not counted).

    Exact counts take one scan: every row's values are packed as (column, text of the value), equal ones
    collapse inside the map tasks, and only distinct values are shuffled. ``approximate=True`` uses HyperLogLog++ sketches
    instead, whose memory doesn't grow with the distinct values.
    """
    if approximate:
        agg = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(c) for c in df.columns])
        return _unpivot_row(agg, df.columns, "n_unique")
    cells = [F.struct(F.lit(i).alias("i"), _exact_text(F.col(f"`{f.name}`"), f.dataType).alias("v")) for i, f in enumerate(df.schema.fields)]
    values = df.select(F.explode(F.array(*cells)).alias("x")).select("x.i", "x.v").filter("v IS NOT NULL").distinct()
    found = values.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "ordinal int, column_name string")
    return names.join(found, F.col("ordinal") == F.col("i"), "left").select("column_name", "ordinal", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_unique"))


def _exact_text(c: Column, dtype: T.DataType) -> Column:
    """A text that two values share if and only if Spark holds them equal."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0)).cast("string")  # one zero
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(c)
    return c.cast("string")


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """P-07 ``s.unique()``: distinct values including NULL."""
    return df.select(column).distinct()


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """P-08 / P-09 ``duplicated().sum()`` over all columns or a key subset (NULLs equal, as pandas).

    Rows are counted by a 64-bit hash of the key columns (partial aggregation, one long per
    distinct row in the shuffle); only rows whose hash repeats are then compared in full, and
    every group of equal rows contributes its size minus one.
    """
    keys = [F.col(f"`{c}`") for c in (subset or df.columns)]
    hashed = df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).withColumn("h", F.xxhash64(*[f"k{i}" for i in range(len(keys))]))
    again = hashed.groupBy(F.col("h").alias("again")).count().filter("count > 1")
    rows = hashed.join(again, F.col("h") == F.col("again"), "left_semi")
    groups = rows.groupBy("h", *[f"k{i}" for i in range(len(keys))]).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """P-10 ``value_counts()``: NULL excluded, most frequent first (ties by value)."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.col("count").desc(), F.col(column).asc())
    )


def null_status_profile(orders: DataFrame, date_columns: Sequence[str]) -> DataFrame:
    """P-11: for each date column, the order statuses behind its NULLs (one pass over orders)."""
    stacked = orders.select(
        "order_status",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().alias("is_null")) for c in date_columns])
        ).alias("s"),
    )
    return (
        stacked.filter(F.col("s.is_null") & F.col("order_status").isNotNull())
        .groupBy(F.col("s.column_name").alias("column_name"), "order_status")
        .count()
    )


def describe(df: DataFrame, columns: Sequence[str], digits: int | None = None, approximate: bool = False) -> DataFrame:
    """P-12 ``describe()``: count, mean, sample std, min, 25/50/75 % (interpolated), max per column.

    Count, mean, std, min and max come from one aggregation over all columns.
    The quartiles are exact by default, computed from global row numbers
    (``operators.quantiles``) so no task holds a whole column; they are not
    the approximate ones of ``DataFrame.summary``. ``approximate=True`` uses
    ``percentile_approx`` sketches instead (one pass, bounded memory, rank
    error 1/10000). ``digits`` optionally rounds the floating-point statistics.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs += [
            F.count(x).alias(f"n{i}"),
            (F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0)).cast("double")).alias(f"mean{i}"),
            F.stddev_samp(x.cast("double")).alias(f"std{i}"),
            F.min(x).cast("double").alias(f"min{i}"),
            F.max(x).cast("double").alias(f"max{i}"),
        ]
        if approximate:
            aggs.append(F.percentile_approx(x.cast("double"), list(QUARTILES), 10000).alias(f"q{i}"))
    agg = df.agg(*aggs)

    def r(c: Column) -> Column:
        return round_double(c, digits) if digits is not None else c

    stats = agg.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(f"n{i}").alias("count"),
                        r(F.col(f"mean{i}")).alias("mean"),
                        r(F.col(f"std{i}")).alias("std"),
                        F.col(f"min{i}").alias("min"),
                        *[
                            (F.col(f"q{i}")[k] if approximate else F.lit(None).cast("double")).alias(name)
                            for k, name in enumerate(QUARTILE_NAMES)
                        ],
                        F.col(f"max{i}").alias("max"),
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("d")
    ).select("d.*")
    if approximate:
        return stats.select(*[r(F.col(c)).alias(c) if c in QUARTILE_NAMES else c for c in stats.columns])
    quartiles = exact_quantiles_many(df, columns, QUARTILES).groupBy("column_name").agg(
        *[r(F.max(F.when(F.col("p") == q, F.col("value")))).alias(name) for q, name in zip(QUARTILES, QUARTILE_NAMES)]
    )
    return stats.drop(*QUARTILE_NAMES).join(quartiles, on="column_name", how="left").select(
        "column_name", "count", "mean", "std", "min", *QUARTILE_NAMES, "max"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """P-13/P-14 pairwise Pearson correlation (pairwise-complete, like pandas) for every pair a < b.

    All pairs in one aggregation. ``pyspark.ml.stat.Correlation`` drops rows
    with any NULL (listwise), which is not what pandas does, so it is not used.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    agg = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"p{k}")
                   for k, (a, b) in enumerate(pairs)])

    def r(c: Column) -> Column:
        return round_double(c, digits) if digits is not None else c

    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), r(F.col(f"p{k}")).alias("corr"))
            for k, (a, b) in enumerate(pairs)]
    return agg.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """P-15 ``hist()``: equal-width bins between min and max, the last bin closed.

    Two aggregations: the global min/max (one row, broadcast) and the counts
    per bin. Every bin is reported, empty ones with count 0.
    """
    x = F.col(column).cast("double")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    binned = (
        df.select(x.alias("x"))
        .filter(F.col("x").isNotNull())
        .crossJoin(F.broadcast(bounds))
        .select(F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
                .cast("bigint").alias("bin"))
        .groupBy("bin")
        .count()
    )
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return (
        all_bins.crossJoin(F.broadcast(bounds))
        .join(binned, on="bin", how="left")
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("lower"),
            F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        )
    )


def head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """P-16 ``head(n)``; with ``order_by`` the first n rows in that order (a top-n, TakeOrderedAndProject)."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """P-17 ``sample(n)``: the n rows whose md5 of seed and key is smallest (a top-n): uniform over keys, and repeatable."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(place, key).limit(n)


# Fixed values that must equal the reference's: the three timeline rules (later event before earlier).
TIMELINE_RULES = [
    ("approved_before_purchase", "order_approved_at", "order_purchase_timestamp"),
    ("carrier_before_approval", "order_delivered_carrier_date", "order_approved_at"),
    ("delivered_before_carrier", "order_delivered_customer_date", "order_delivered_carrier_date"),
]


def timeline_violations(orders: DataFrame) -> DataFrame:
    """P-18: orders whose events are out of order, with a flag per rule (NULL dates never violate)."""
    flags = {name: F.coalesce(F.col(later) < F.col(earlier), F.lit(False)) for name, later, earlier in TIMELINE_RULES}
    cond = None
    for f in flags.values():
        cond = f if cond is None else (cond | f)
    return orders.select("order_id", "order_status", *[v.alias(k) for k, v in flags.items()]).filter(cond)


__all__ = [
    "correlation_matrix",
    "describe",
    "distinct_counts",
    "duplicate_rows",
    "head",
    "histogram",
    "info",
    "null_counts",
    "null_status_profile",
    "sample_rows",
    "shape",
    "timeline_violations",
    "unique_values",
    "value_counts",
]

