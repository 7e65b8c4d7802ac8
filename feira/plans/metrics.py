"""Headline metrics (the README's business questions), computed from the views.

Money shares are summed as exact decimals (the rounded view values cast back
to DECIMAL) so the results do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions import money, ratio_pct_round, ratio_round, round_double
from feira.plans.customers import BUYER_TYPES, cohort_retention, repeat_purchase_rate, rfm_scores
from feira.plans.delivery import delay_review_rows
from feira.plans.payments import payment_method_analysis
from feira.plans.revenue import PARETO_TOP, category_performance
from feira.plans.sellers import DELIVERY_TIER_ELSE, seller_delivery_vs_reviews
from feira.sources.bridge import Tables

TOP_CATEGORIES = 10


def _dec(c: str) -> F.Column:
    return F.col(c).cast("decimal(38,2)")


def one_time_buyer_share(t: Tables) -> DataFrame:
    """M-01 share of persons who never placed a second delivered order (from V-04)."""
    rpr = repeat_purchase_rate(t)
    return rpr.agg(
        F.sum(F.when(F.col("buyer_type") == BUYER_TYPES[0], F.col("customer_count")).otherwise(0)).alias("one_time"),
        F.sum("customer_count").alias("total"),
    ).select(
        F.col("one_time").cast("bigint").alias("one_time_customers"),
        F.col("total").cast("bigint").alias("total_customers"),
        ratio_round(F.col("one_time") * 100, "total", 2).alias("one_time_pct"),
    )


def late_delivery_score_gap(t: Tables) -> DataFrame:
    """M-02 average review score of late (delay > 0) vs not late deliveries, and the gap."""
    late = F.col("delay_days") > 0
    score = F.col("review_score").cast("bigint")
    agg = delay_review_rows(t).agg(
        F.sum(F.when(late, score)).alias("s_late"),
        F.count(F.when(late, score)).alias("n_late"),
        F.sum(F.when(~late, score)).alias("s_ok"),
        F.count(F.when(~late, score)).alias("n_ok"),
    )
    avg_ok = F.col("s_ok").cast("double") / F.nullif(F.col("n_ok"), F.lit(0)).cast("double")
    avg_late = F.col("s_late").cast("double") / F.nullif(F.col("n_late"), F.lit(0)).cast("double")
    return agg.select(
        F.col("n_late").alias("late_reviews"),
        F.col("n_ok").alias("not_late_reviews"),
        ratio_round("s_late", "n_late", 3).alias("avg_score_late"),
        ratio_round("s_ok", "n_ok", 3).alias("avg_score_not_late"),
        round_double(avg_ok - avg_late, 3).alias("score_gap"),
    )


def pareto_summary(t: Tables) -> DataFrame:
    """M-03 categories in the top 80 % and the revenue share of the top 10 categories (from V-02)."""
    cp = category_performance(t)
    return cp.agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.count_if(F.col("pareto_group") == PARETO_TOP).alias("top80_categories"),
        F.sum(F.when(F.col("revenue_rank") <= TOP_CATEGORIES, _dec("total_revenue")).otherwise(F.lit(0))).alias("top"),
        F.sum(_dec("total_revenue")).alias("all"),
    ).select("n_categories", "top80_categories", ratio_pct_round("top", "all", 2).alias("top10_revenue_share_pct"))


def sellers_below_on_time_target(t: Tables) -> DataFrame:
    """M-04 share of sellers under 70 % on-time delivery (tier 'Needs Improvement', from V-09)."""
    sd = seller_delivery_vs_reviews(t)
    return sd.agg(
        F.count(F.lit(1)).alias("n_sellers"),
        F.count_if(F.col("delivery_tier") == DELIVERY_TIER_ELSE).alias("below_70_sellers"),
    ).select("n_sellers", "below_70_sellers", ratio_round(F.col("below_70_sellers") * 100, "n_sellers", 2).alias("below_70_pct"))


def payment_revenue_share(t: Tables) -> DataFrame:
    """M-05 revenue share per payment type (from V-10); the window runs over the handful of types."""
    pm = payment_method_analysis(t)
    value = _dec("total_payment_value")
    return pm.select(
        "payment_type",
        "total_payment_value",
        ratio_round(value * 100, F.sum(value).over(W.partitionBy()), 2).alias("revenue_share_pct"),
    )


def segment_share(t: Tables, scores: DataFrame | None = None) -> DataFrame:
    """M-06 persons and revenue per RFM segment with their shares (from V-06)."""
    scored = rfm_scores(t) if scores is None else scores
    per_segment = scored.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monetary_dec").alias("revenue_dec")
    )
    everyone = W.partitionBy()
    return per_segment.select(
        "rfm_segment",
        "customers",
        ratio_round(F.col("customers") * 100, F.sum("customers").over(everyone), 2).alias("customer_share_pct"),
        money("revenue_dec").alias("revenue"),
        ratio_round(F.col("revenue_dec") * 100, F.sum("revenue_dec").over(everyone), 2).alias("revenue_share_pct"),
    )


def retention_matrix(t: Tables) -> DataFrame:
    """M-07 the cohort x month retention heat-map in long form, from V-05.

    One row per cohort and month number from 0 to the largest of any cohort;
    a month in which nobody of the cohort bought has a NULL rate. The grid is
    built from the aggregated cells, so it is as small as the heat-map.
    """
    cells = cohort_retention(t).select("cohort_month", "cohort_customers", "month_number", "retention_rate_pct")
    last = cells.agg(F.max("month_number").alias("last"))
    grid = (
        cells.select("cohort_month", "cohort_customers").distinct().crossJoin(F.broadcast(last))
        .select("cohort_month", "cohort_customers", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("month_number"))
    )
    rates = cells.select("cohort_month", F.col("month_number").cast("bigint").alias("month_number"), "retention_rate_pct")
    return grid.join(rates, on=["cohort_month", "month_number"], how="left").select(
        "cohort_month", "cohort_customers", "month_number", "retention_rate_pct"
    )
