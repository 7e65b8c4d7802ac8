"""Views over incrementally refreshed sources (V-01, V-10, V-11): the same results from merged per-file partials.

``src`` is the folder of the CSV sources (or each one's folder by its name); a call reads only the files that were added or changed since the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import first_of_month, money, ratio_round
from feira.plans.common import delivered_orders
from feira.plans.revenue import trends_of_orders
from feira.sources.csv_io import Sources
from feira.sources.increments import ITEMS, PAYMENTS, refreshed, refreshed_orders


def revenue_trends(spark: SparkSession, src: Sources) -> DataFrame:
    """V-01 from the files' item sums per order."""
    return trends_of_orders(refreshed_orders(spark, src), refreshed(spark, src, ITEMS))


def payment_method_analysis(spark: SparkSession, src: Sources) -> DataFrame:
    """V-10 from the files' payment sums per order, type and number of installments."""
    orders = delivered_orders(refreshed_orders(spark, src))
    inst, n = F.col("payment_installments").cast("bigint"), F.col("payments")
    per_type = refreshed(spark, src, PAYMENTS).join(orders, on="order_id", how="left_semi").groupBy("payment_type").agg(
        F.countDistinct("order_id").alias("total_orders"),
        F.sum("value_sum").alias("value_sum"),
        F.sum("value_n").alias("value_n"),
        F.sum(inst * n).alias("inst_sum"),
        F.sum(F.when(inst.isNotNull(), n).otherwise(0)).alias("inst_n"),
        F.sum(F.when(inst > 1, n).otherwise(0)).alias("installment_orders"),
    )
    return per_type.select(
        "payment_type",
        "total_orders",
        money("value_sum").alias("total_payment_value"),
        ratio_round("value_sum", "value_n", 2).alias("avg_payment_value"),
        ratio_round("inst_sum", "inst_n", 2).alias("avg_installments"),
        "installment_orders",
    )


def monthly_revenue_by_payment(spark: SparkSession, src: Sources) -> DataFrame:
    """V-11 from the same sums; the share window runs over the (month, type) table."""
    orders = delivered_orders(refreshed_orders(spark, src), "order_purchase_timestamp")
    cells = refreshed(spark, src, PAYMENTS).join(orders, on="order_id").groupBy(
        first_of_month("order_purchase_timestamp").alias("month_start"), "payment_type").agg(
        F.countDistinct("order_id").alias("total_orders"), F.sum("value_sum").alias("value_sum"), F.sum("value_n").alias("value_n"))
    month_total = F.sum("value_sum").over(W.partitionBy("month_start"))
    return cells.select(
        "month_start",
        "payment_type",
        "total_orders",
        money("value_sum").alias("total_revenue"),
        ratio_round("value_sum", "value_n", 2).alias("avg_order_value"),
        ratio_round(F.col("value_sum") * 100, month_total, 2).alias("monthly_revenue_share_pct"),
    )
