"""Revenue views: monthly trends (V-01), category Pareto (V-02), price vs review (V-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import (
    first_of_month,
    money,
    ratio_pct_round,
    ratio_round,
    round_double,
    sample_stdev,
)
from feira.plans.common import (
    RV_N,
    RV_SUM,
    RV_SUMSQ,
    delivered_orders,
    first_of,
    item_value,
    with_review_weights,
    wsum,
)
from feira.sources.bridge import Tables

# Fixed values that must equal the reference's.
PARETO_TOP, PARETO_TAIL, PARETO_CUTOFF_PCT = "Top 80%", "Long Tail", 80
# Price buckets as (label, condition on the price): the first match wins and the bounds are inclusive,
# while the sort order of a bucket counts the bounds that a price reaches.
PRICE_BUCKETS = [
    ("Under R$50", "price < 50"),
    ("R$50–100", "price BETWEEN 50 AND 100"),
    ("R$100–250", "price BETWEEN 100 AND 250"),
    ("R$250–500", "price BETWEEN 250 AND 500"),
    ("Over R$500", "TRUE"),
]
PRICE_BOUNDS = [50, 100, 250, 500]


def revenue_trends(t: Tables) -> DataFrame:
    """V-01 vw_revenue_trends: per month totals with MoM / YoY growth, 3-month average and YTD.

    Items are summed per order before the join (one row per order), so the
    join is one-to-one and the month aggregate reads orders, not items.
    The window functions run over the monthly table (one row per month).
    """
    per_order = t.order_items.groupBy("order_id").agg(
        F.sum(item_value()).alias("gross"),
        F.sum("price").alias("product"),
        F.sum("freight_value").alias("freight"),
    )
    return trends_of_orders(t, per_order)


def trends_of_orders(t: Tables, per_order: DataFrame) -> DataFrame:
    """V-01 from the item sums of every order."""
    monthly = (
        delivered_orders(t, "customer_id", "order_purchase_timestamp")
        .join(per_order, on="order_id")
        .groupBy(first_of_month("order_purchase_timestamp").alias("month_start"))
        .agg(
            F.count("order_id").alias("total_orders"),
            F.countDistinct("customer_id").alias("unique_customers"),
            F.sum("gross").alias("gross_sum"),
            F.sum("product").alias("product_sum"),
            F.sum("freight").alias("freight_sum"),
        )
        .withColumn("g", F.round("gross_sum", 2))
    )
    by_month = W.orderBy("month_start")
    g, prev, last_year = F.col("g"), F.lag("g", 1).over(by_month), F.lag("g", 12).over(by_month)
    three = by_month.rowsBetween(-2, W.currentRow)
    ytd = W.partitionBy(F.year("month_start")).orderBy("month_start")
    return monthly.select(
        "month_start",
        "total_orders",
        "unique_customers",
        money("g").alias("gross_revenue"),
        money("product_sum").alias("product_revenue"),
        money("freight_sum").alias("freight_revenue"),
        ratio_round("gross_sum", "total_orders", 2).alias("aov"),
        prev.cast("double").alias("prev_month_revenue"),
        ratio_pct_round(g - prev, prev, 2).alias("mom_growth_pct"),
        last_year.cast("double").alias("same_month_last_year"),
        ratio_pct_round(g - last_year, last_year, 2).alias("yoy_growth_pct"),
        ratio_round(F.sum(g).over(three), F.count(g).over(three), 2).alias("revenue_3mo_avg"),
        money(F.sum(g).over(ytd)).alias("ytd_revenue"),
    )


def delivered_item_groups(t: Tables, *keys: Column | str) -> DataFrame:
    """Delivered items collapsed per (order, keys) before any join, then given their order's review weights.

    ``items`` rows, ``units`` (items with an id), ``price_sum`` and ``price_n`` of each group; an order
    with a third of all items is reduced to its few groups inside the map tasks, so
    the joins on ``order_id`` meet one row per group.
    """
    groups = t.order_items.groupBy("order_id", *keys).agg(
        F.count(F.lit(1)).alias("items"),
        F.count("order_item_id").alias("units"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
    )
    return with_review_weights(groups.join(delivered_orders(t), on="order_id", how="left_semi"), t)


def per_category(t: Tables) -> DataFrame:
    """The per-category aggregate of V-02 (before the ranking windows)."""
    products = t.products.select("product_id", "category_name")
    rows = delivered_item_groups(t, "product_id").join(products, on="product_id")
    return (
        rows.filter(F.col("category_name").isNotNull())
        .withColumn("first", first_of("order_id", "category_name", by="product_id"))
        .groupBy("category_name")
        .agg(
            F.sum("first").alias("total_orders"),
            wsum(F.col("units")).alias("units_sold"),
            F.round(wsum(F.col("price_sum")), 2).alias("revenue_dec"),
            wsum(F.col("price_n")).alias("n_price"),
            F.sum(F.col(RV_SUM) * F.col("items")).alias("score_sum"),
            F.sum(F.col(RV_N) * F.col("items")).alias("score_n"),
        )
    )


def category_performance(t: Tables) -> DataFrame:
    """V-02 vw_category_performance with revenue rank, share, cumulative share and Pareto group.

    Windows run over the per-category table (one row per category). The
    running sum breaks revenue ties by category name (SURVEY D13); the Pareto
    test compares exact decimals (running * 100 <= total * 80).
    """
    base = per_category(t)
    rev = F.col("revenue_dec")
    total = F.sum(rev).over(W.partitionBy())
    running = F.sum(rev).over(
        W.orderBy(rev.desc(), F.col("category_name").asc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return base.select(
        "category_name",
        "total_orders",
        "units_sold",
        money(rev).alias("total_revenue"),
        ratio_round(rev, "n_price", 2).alias("avg_price"),
        ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        F.rank().over(W.orderBy(rev.desc())).cast("bigint").alias("revenue_rank"),
        ratio_pct_round(rev, total, 2).alias("revenue_share_pct"),
        ratio_pct_round(running, total, 2).alias("cumulative_revenue_pct"),
        F.when(running * 100 <= total * PARETO_CUTOFF_PCT, PARETO_TOP).otherwise(PARETO_TAIL).alias("pareto_group"),
    )


def price_bucket_label() -> Column:
    """The label of ``price``; a NULL price falls through to the last bucket."""
    chain = None
    for label, cond in PRICE_BUCKETS:
        test = F.expr(cond)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def price_bucket_order() -> Column:
    """The sort order of ``price``; a NULL price comes last."""
    reached = sum((F.when(F.col("price") < bound, 0).otherwise(1) for bound in PRICE_BOUNDS), F.lit(1))
    return reached.cast("bigint")


def price_review_correlation(t: Tables) -> DataFrame:
    """V-03 vw_price_review_correlation: review statistics per price bucket.

    The reference pairs each delivered item with each non-NULL review of its
    order. Per item, that is ``rv_n`` rows with the order's score moments, so
    counts, means and the sample standard deviation come from summed moments.
    """
    rows = delivered_item_groups(
        t, price_bucket_label().alias("price_bucket"), price_bucket_order().alias("bucket_order")
    ).filter(F.col(RV_N) > 0)
    items, per_item = F.col("items"), F.col(RV_N)
    agg = rows.groupBy("price_bucket", "bucket_order").agg(
        F.sum(per_item * items).alias("n"),
        F.sum(F.col(RV_SUM) * items).alias("s"),
        F.sum(F.col(RV_SUMSQ) * items).alias("ss"),
        wsum(F.col("price_sum"), per_item).alias("price_sum"),
        wsum(F.col("price_n"), per_item).alias("price_n"),
    )
    return agg.select(
        "price_bucket",
        "bucket_order",
        F.col("n").cast("bigint").alias("total_records"),
        ratio_round("s", "n", 3).alias("avg_review_score"),
        ratio_round("price_sum", "price_n", 2).alias("avg_price"),
        round_double(sample_stdev("n", "s", "ss"), 3).alias("review_score_stdev"),
    )
