"""Seller views: performance and health score (V-08), delivery vs reviews (V-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions import day_diff, int_div, money, ratio_pct_round, ratio_round
from feira.operators.ranking import RankOut, with_global_ranks
from feira.plans.common import (
    RV_N,
    RV_SUM,
    delivered_orders,
    first_of,
    wcount,
    wcount_if,
    weight,
    with_review_weights,
    wsum,
)
from feira.sources.bridge import Tables

# Fixed values that must equal the reference's.
DELIVERY_TIERS = [("High Performer", 90), ("Average", 70)]
DELIVERY_TIER_ELSE = "Needs Improvement"
HEALTH_WEIGHTS = (4, 3, 3)  # tenths: revenue tile 0.4, review tile 0.3, orders tile 0.3


def per_seller(t: Tables) -> DataFrame:
    """Per-seller aggregate of V-08 before its ranks, the review fan-out as weights.

    Items collapse to (order, seller, product) inside the map tasks, before the
    joins. A seller's first row of every order is marked, and the rows collapse to (seller, product), so that both
    distinct counts become sums and no row is copied for them.
    """
    groups = t.order_items.groupBy("order_id", "seller_id", "product_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("order_item_id").alias("units"),
        F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"),
    )
    seller = ["seller_id", "seller_city", "seller_state"]
    rows = with_review_weights(
        groups.join(delivered_orders(t, "order_purchase_timestamp"), on="order_id"), t
    ).join(t.sellers.select(*seller), on="seller_id")
    per_product = rows.withColumn("first", first_of("order_id", *seller, by="product_id")).groupBy(*seller, "product_id").agg(
        F.sum("first").alias("orders"),
        wsum(F.col("units")).alias("units"),
        wsum(F.col("price_sum")).alias("revenue"),
        wsum(F.col("price_n")).alias("n"),
        F.sum(F.col(RV_SUM) * F.col("items")).alias("s_sum"),
        F.sum(F.col(RV_N) * F.col("items")).alias("s_n"),
        F.min("order_purchase_timestamp").alias("first_at"),
        F.max("order_purchase_timestamp").alias("last_at"),
    )
    return per_product.groupBy(*seller).agg(
        F.sum("orders").alias("total_orders"),
        F.sum("units").alias("units_sold"),
        F.round(F.sum("revenue"), 2).alias("revenue_dec"),
        F.sum("n").alias("n_price"),
        F.sum("s_sum").alias("score_sum"),
        F.sum("s_n").alias("score_n"),
        F.count("product_id").alias("unique_products"),
        F.min("first_at").alias("first_sale"),
        F.max("last_at").alias("last_sale"),
    ).select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        "units_sold",
        "revenue_dec",
        ratio_round("revenue_dec", "n_price", 2).alias("avg_selling_price"),
        ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        "unique_products",
        (day_diff("first_sale", "last_sale") + 1).alias("active_days"),
    )


def seller_performance(t: Tables) -> DataFrame:
    """V-08 vw_seller_performance with ranks, revenue quartile and the composite health score.

    All ranks and tiles are global over sellers and use the distributed
    ranking operator; tiles break ties by md5(seller_id), seller_id (D13).
    Directions are the reference's (revenue and orders DESC, review ASC, D14);
    a seller without reviews has a NULL average, first in ASC and last in DESC.
    """
    base = per_seller(t)
    ranked = with_global_ranks(
        base,
        "seller_id",
        [
            RankOut("revenue_rank", "revenue_dec", False, "rank"),
            RankOut("revenue_quartile", "revenue_dec", False, "ntile", 4),
            RankOut("_rev5", "revenue_dec", False, "ntile", 5),
            RankOut("review_rank", "avg_review_score", False, "rank"),
            RankOut("_review5", "avg_review_score", True, "ntile", 5),
            RankOut("_orders5", "total_orders", False, "ntile", 5),
        ],
    )
    wr, wv, wo = HEALTH_WEIGHTS
    health = (F.col("_rev5") * wr + F.col("_review5") * wv + F.col("_orders5") * wo).cast("double") / F.lit(10.0)
    return ranked.select(
        "seller_id",
        "seller_city",
        "seller_state",
        "total_orders",
        "units_sold",
        money("revenue_dec").alias("total_revenue"),
        "avg_selling_price",
        "avg_review_score",
        "unique_products",
        "active_days",
        ratio_pct_round("revenue_dec", "active_days", 2, scale=30).alias("monthly_revenue_rate"),
        "revenue_rank",
        "review_rank",
        "revenue_quartile",
        health.alias("seller_health_score"),
    )


def seller_delivery_vs_reviews(t: Tables) -> DataFrame:
    """V-09 vw_seller_delivery_vs_reviews: on-time rate, transit days and tier per seller.

    Numerators count item x review rows, the denominator distinct orders, as
    in the reference (D10), so the rate can exceed 100. Day averages are
    T-SQL integer averages (truncated).
    """
    orders = delivered_orders(
        t, "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"
    ).filter(F.col("order_delivered_customer_date").isNotNull())
    per_order_seller = t.order_items.groupBy("order_id", "seller_id").agg(F.count(F.lit(1)).alias("items"))
    rows = with_review_weights(per_order_seller.join(orders, on="order_id"), t)
    fan = F.col("items") * weight()
    delivered, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    transit = day_diff("order_delivered_carrier_date", "order_delivered_customer_date")
    vs_estimate = day_diff("order_delivered_customer_date", "order_estimated_delivery_date")
    agg = rows.groupBy("seller_id").agg(
        F.count("order_id").alias("total_orders"),  # one row per order and seller
        wcount_if(delivered <= estimated, fan).alias("on_time_deliveries"),
        F.sum(F.col(RV_SUM) * F.col("items")).alias("score_sum"),
        F.sum(F.col(RV_N) * F.col("items")).alias("score_n"),
        wsum(transit, fan).alias("transit_sum"),
        wcount(transit, fan).alias("transit_n"),
        wsum(vs_estimate, fan).alias("vs_sum"),
        wcount(vs_estimate, fan).alias("vs_n"),
    )
    on_time, orders_n = F.col("on_time_deliveries"), F.col("total_orders")
    (high, high_pct), (avg, avg_pct) = DELIVERY_TIERS
    return agg.select(
        "seller_id",
        "total_orders",
        on_time.cast("bigint").alias("on_time_deliveries"),
        ratio_round(on_time * 100, orders_n, 2).alias("on_time_rate_pct"),
        ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        int_div("transit_sum", "transit_n").alias("avg_transit_days"),
        int_div("vs_sum", "vs_n").alias("avg_days_vs_estimate"),
        F.when(on_time * 100 >= orders_n * high_pct, high)
        .when(on_time * 100 >= orders_n * avg_pct, avg)
        .otherwise(DELIVERY_TIER_ELSE)
        .alias("delivery_tier"),
    )

