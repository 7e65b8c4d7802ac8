"""Geography and delivery views: revenue by state (V-12), monthly delivery (V-13),
delivery by state (V-14), delay vs review (V-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import count_when, day_diff, first_of_month, int_div, money, ratio_pct_round, ratio_round
from feira.plans.common import (
    RV_N,
    RV_SUM,
    delivered_orders,
    item_value,
    wcount,
    wcount_if,
    with_review_weights,
    wsum,
)
from feira.sources.bridge import Tables

# Fixed values that must equal the reference's: delay buckets on
# delay = DATEDIFF(DAY, estimated, delivered), as (label, sort order, condition); the first match wins.
DELAY_BUCKETS = [
    ("Very Early (7d+)", 1, "delay_days <= -7"),
    ("Early (1-6d)", 2, "delay_days BETWEEN -6 AND -1"),
    ("On Time", 3, "delay_days = 0"),
    ("Slightly Late (1-3d)", 4, "delay_days BETWEEN 1 AND 3"),
    ("Late (4-7d)", 5, "delay_days BETWEEN 4 AND 7"),
    ("Very Late (7d+)", 6, "TRUE"),
]


def _items_per_order(t: Tables) -> DataFrame:
    """Item count and value moments per order (one row per order that has items)."""
    v = item_value()
    return t.order_items.groupBy("order_id").agg(
        F.sum(v).alias("value_sum"),
        F.count(v).alias("value_n"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("freight_value").alias("freight_sum"),
        F.count("freight_value").alias("freight_n"),
    )


def revenue_by_state(t: Tables) -> DataFrame:
    """V-12 vw_revenue_by_state.

    The reference's rows are order x item x review. Items are aggregated per
    order, reviews too, so the state aggregate reads one row per order:
    sums are weighted by the order's review rows, the review average by its
    item count.
    """
    customers = t.customers.select("customer_id", "customer_unique_id", "customer_state")
    rows = with_review_weights(
        delivered_orders(t, "customer_id").join(customers, on="customer_id").join(_items_per_order(t), on="order_id"),
        t,
    )
    n_items = F.col("n_items")
    agg = rows.groupBy("customer_state").agg(
        F.count("order_id").alias("total_orders"),  # one row per order
        F.countDistinct("customer_unique_id").alias("unique_customers"),
        wsum(F.col("value_sum")).alias("revenue"),
        wsum(F.col("value_n")).alias("revenue_n"),
        F.sum(F.col(RV_SUM) * n_items).alias("score_sum"),
        F.sum(F.col(RV_N) * n_items).alias("score_n"),
    )
    return agg.select(
        "customer_state",
        "total_orders",
        "unique_customers",
        money("revenue").alias("total_revenue"),
        ratio_round("revenue", "revenue_n", 2).alias("avg_order_value"),
        ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        ratio_round(F.col("revenue") * 100, F.sum("revenue").over(W.partitionBy()), 2).alias("revenue_share_pct"),
    )


def delivery_performance_monthly(t: Tables) -> DataFrame:
    """V-13 vw_delivery_performance_monthly (orders only; NULL delivery dates kept, D17)."""
    delivered, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    days = day_diff("order_purchase_timestamp", "order_delivered_customer_date")
    vs_estimate = day_diff("order_delivered_customer_date", "order_estimated_delivery_date")
    agg = (
        delivered_orders(
            t, "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"
        )
        .groupBy(first_of_month("order_purchase_timestamp").alias("month_start"))
        .agg(
            F.count("order_id").alias("total_orders"),
            count_when(delivered <= estimated).alias("on_time"),
            count_when(delivered > estimated).alias("late"),
            F.sum(days).alias("days_sum"),
            F.count(days).alias("days_n"),
            F.sum(vs_estimate).alias("vs_sum"),
            F.count(vs_estimate).alias("vs_n"),
        )
    )
    return agg.select(
        "month_start",
        "total_orders",
        "on_time",
        "late",
        ratio_pct_round("on_time", "total_orders", 2).alias("on_time_rate_pct"),
        int_div("days_sum", "days_n").alias("avg_delivery_days"),
        int_div("vs_sum", "vs_n").alias("avg_days_vs_estimate"),
    )


def delivery_by_state(t: Tables) -> DataFrame:
    """V-14 vw_delivery_by_state with rank windows over the per-state table.

    Order-level day differences are weighted by (items x review rows) of the
    order, freight by review rows, review scores by item count.
    """
    customers = t.customers.select("customer_id", "customer_state")
    orders = delivered_orders(
        t, "customer_id", "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"
    ).filter(F.col("order_delivered_customer_date").isNotNull())
    rows = with_review_weights(orders.join(customers, on="customer_id").join(_items_per_order(t), on="order_id"), t)
    fan = F.col("n_items") * F.col("rv_rows")
    delivered, estimated = F.col("order_delivered_customer_date"), F.col("order_estimated_delivery_date")
    days = day_diff("order_purchase_timestamp", "order_delivered_customer_date")
    delay = day_diff("order_delivered_customer_date", "order_estimated_delivery_date")
    agg = rows.groupBy("customer_state").agg(
        F.count("order_id").alias("total_orders"),  # one row per order
        wsum(days, fan).alias("days_sum"),
        wcount(days, fan).alias("days_n"),
        wsum(delay, fan).alias("delay_sum"),
        wcount(delay, fan).alias("delay_n"),
        wcount_if(delivered > estimated, fan).alias("late_orders"),
        F.sum(F.col(RV_SUM) * F.col("n_items")).alias("score_sum"),
        F.sum(F.col(RV_N) * F.col("n_items")).alias("score_n"),
        wsum(F.col("freight_sum")).alias("freight_sum"),
        wsum(F.col("freight_n")).alias("freight_n"),
    ).select(
        "customer_state",
        "total_orders",
        int_div("days_sum", "days_n").alias("avg_delivery_days"),
        int_div("delay_sum", "delay_n").alias("avg_delay_days"),
        F.col("late_orders").cast("bigint").alias("late_orders"),
        ratio_round(F.col("late_orders") * 100, "total_orders", 2).alias("late_rate_pct"),
        ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        ratio_round("freight_sum", "freight_n", 2).alias("avg_freight_cost"),
    )
    return agg.select(
        "*",
        F.rank().over(W.orderBy(F.col("avg_delivery_days").desc())).cast("bigint").alias("slowest_delivery_rank"),
        F.rank().over(W.orderBy(F.col("late_orders").desc())).cast("bigint").alias("most_late_rank"),
    )


def delay_bucket() -> tuple[F.Column, F.Column]:
    """Label and sort order of the bucket of ``delay_days`` (whole days)."""
    label = " ".join(f"WHEN {cond} THEN '{name}'" for name, _, cond in DELAY_BUCKETS)
    order = " ".join(f"WHEN {cond} THEN {place}" for _, place, cond in DELAY_BUCKETS)
    return F.expr(f"CASE {label} END"), F.expr(f"CASE {order} END").cast("bigint")


def delay_review_rows(t: Tables) -> DataFrame:
    """One row per (delivered order, non-NULL review): order_id, delay_days, review_score."""
    orders = delivered_orders(t, "order_delivered_customer_date", "order_estimated_delivery_date").filter(
        F.col("order_delivered_customer_date").isNotNull()
    )
    reviews = t.order_reviews.select("order_id", "review_score").filter(F.col("review_score").isNotNull())
    return orders.join(reviews, on="order_id").select(
        "order_id",
        day_diff("order_estimated_delivery_date", "order_delivered_customer_date").alias("delay_days"),
        "review_score",
    )


def delay_vs_review(t: Tables) -> DataFrame:
    """V-15 vw_delay_vs_review: review statistics per delivery-delay bucket (one row per review)."""
    label, order = delay_bucket()
    score = F.col("review_score")
    return (
        delay_review_rows(t)
        .groupBy(label.alias("delay_bucket"), order.alias("bucket_sort"))
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum(score.cast("bigint")).alias("s"),
            F.count(score).alias("n"),
            count_when(score == 5).alias("five_star_count"),
            count_when(score <= 2).alias("low_score_count"),
        )
        .select(
            "delay_bucket",
            "bucket_sort",
            "order_count",
            ratio_round("s", "n", 3).alias("avg_review_score"),
            "five_star_count",
            "low_score_count",
        )
    )
