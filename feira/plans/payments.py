"""Payment views: method mix (V-10), monthly split by method (V-11), installments (V-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import count_when, first_of_month, money, ratio_round
from feira.plans.common import RV_N, RV_SUM, delivered_orders, with_review_weights, wsum
from feira.sources.bridge import Tables


def _delivered_payments(t: Tables, *order_cols: str) -> DataFrame:
    payments = t.order_payments.select("order_id", "payment_type", "payment_installments", "payment_value")
    orders = delivered_orders(t, *order_cols)
    if order_cols:
        return payments.join(orders, on="order_id")
    return payments.join(orders, on="order_id", how="left_semi")


def payment_method_analysis(t: Tables) -> DataFrame:
    """V-10 vw_payment_method_analysis: totals per payment type over delivered orders."""
    value, inst = F.col("payment_value"), F.col("payment_installments")
    return (
        _delivered_payments(t)
        .groupBy("payment_type")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.sum(value).alias("value_sum"),
            F.count(value).alias("value_n"),
            F.sum(inst.cast("bigint")).alias("inst_sum"),
            F.count(inst).alias("inst_n"),
            count_when(inst > 1).alias("installment_orders"),
        )
        .select(
            "payment_type",
            "total_orders",
            money("value_sum").alias("total_payment_value"),
            ratio_round("value_sum", "value_n", 2).alias("avg_payment_value"),
            ratio_round("inst_sum", "inst_n", 2).alias("avg_installments"),
            "installment_orders",
        )
    )


def monthly_revenue_by_payment(t: Tables) -> DataFrame:
    """V-11 vw_monthly_revenue_by_payment: per (month, type) with the type's share of the month.

    The share window is partitioned by month over the aggregated (month, type) table.
    """
    value = F.col("payment_value")
    agg = (
        _delivered_payments(t, "order_purchase_timestamp")
        .groupBy(first_of_month("order_purchase_timestamp").alias("month_start"), "payment_type")
        .agg(
            F.countDistinct("order_id").alias("total_orders"),
            F.sum(value).alias("value_sum"),
            F.count(value).alias("value_n"),
        )
    )
    month_total = F.sum("value_sum").over(W.partitionBy("month_start"))
    return agg.select(
        "month_start",
        "payment_type",
        "total_orders",
        money("value_sum").alias("total_revenue"),
        ratio_round("value_sum", "value_n", 2).alias("avg_order_value"),
        ratio_round(F.col("value_sum") * 100, month_total, 2).alias("monthly_revenue_share_pct"),
    )


def installments_analysis(t: Tables) -> DataFrame:
    """V-16 vw_installments_analysis: per installment count (> 0), review fan-out as weights.

    Payments collapse to (order, installments) inside the map tasks, before the joins.
    """
    groups = (
        t.order_payments.filter(F.col("payment_installments") > 0)
        .groupBy("order_id", "payment_installments")
        .agg(
            F.count(F.lit(1)).alias("payments"),
            F.sum("payment_value").alias("value_sum"),
            F.count("payment_value").alias("value_n"),
        )
    )
    rows = with_review_weights(groups.join(delivered_orders(t), on="order_id", how="left_semi"), t)
    return (
        rows.groupBy("payment_installments")
        .agg(
            F.count("order_id").alias("total_orders"),  # one row per order and installment count
            wsum(F.col("value_sum")).alias("value_sum"),
            wsum(F.col("value_n")).alias("value_n"),
            F.sum(F.col(RV_SUM) * F.col("payments")).alias("score_sum"),
            F.sum(F.col(RV_N) * F.col("payments")).alias("score_n"),
        )
        .select(
            F.col("payment_installments").cast("bigint").alias("payment_installments"),
            "total_orders",
            ratio_round("value_sum", "value_n", 2).alias("avg_order_value"),
            money("value_sum").alias("total_revenue"),
            ratio_round("score_sum", "score_n", 2).alias("avg_review_score"),
        )
    )
