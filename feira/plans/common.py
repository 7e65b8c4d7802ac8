"""Building blocks shared by the views.

The reference joins ``order_reviews`` with a LEFT JOIN after the item (or
payment) rows, so an order with r reviews contributes each of its item rows r
times (SURVEY D9/D10). Emitting those item x review pairs would blow up on an
order that has many of both. Instead reviews are aggregated to one row per
order first (``review_stats``) and every fanned-out aggregate is computed as a
weighted aggregate over the un-multiplied rows:

* a row repeated ``w = max(review rows, 1)`` times adds ``w`` to counts and
  ``w * x`` to sums;
* the average review score over the repeated rows is
  ``sum(per-order score sum) / sum(per-order score count)`` over the rows.

The results equal the fanned-out ones exactly (integer and decimal arithmetic),
and every join stays one-to-one on ``order_id``.

``orders.order_id`` is the key of ``orders`` (as in the source data model), so
joins against delivered orders never multiply rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.sources.bridge import Tables

DELIVERED = "delivered"

# Column names produced by ``review_stats``.
RV_ROWS, RV_N, RV_SUM, RV_SUMSQ = "rv_rows", "rv_n", "rv_sum", "rv_sumsq"


def delivered_orders(t: Tables, *cols: str) -> DataFrame:
    """Delivered orders projected to ``order_id`` and ``cols`` (the filter reaches the scan)."""
    return t.orders.filter(F.col("order_status") == DELIVERED).select("order_id", *cols)


def review_stats(t: Tables) -> DataFrame:
    """One row per reviewed order: review row count and exact score moments."""
    score = F.col("review_score").cast("bigint")
    return t.order_reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias(RV_ROWS),
        F.count(score).alias(RV_N),
        F.sum(score).alias(RV_SUM),
        F.sum(score * score).alias(RV_SUMSQ),
    )


def with_review_weights(rows: DataFrame, t: Tables) -> DataFrame:
    """LEFT JOIN of ``review_stats`` on ``order_id``; orders without reviews get weight 1 and no scores."""
    return (
        rows.join(review_stats(t), on="order_id", how="left")
        .withColumn(RV_ROWS, F.coalesce(F.col(RV_ROWS), F.lit(1)).cast("bigint"))
        .withColumn(RV_N, F.coalesce(F.col(RV_N), F.lit(0)).cast("bigint"))
        .withColumn(RV_SUM, F.coalesce(F.col(RV_SUM), F.lit(0)).cast("bigint"))
        .withColumn(RV_SUMSQ, F.coalesce(F.col(RV_SUMSQ), F.lit(0)).cast("bigint"))
    )


def weight() -> Column:
    return F.col(RV_ROWS)


def wsum(x: Column, w: Column | None = None) -> Column:
    """Sum of ``x`` over the fanned-out rows (each row repeated ``w`` times)."""
    return F.sum(x * (weight() if w is None else w))


def wcount(x: Column, w: Column | None = None) -> Column:
    """COUNT(x) over the fanned-out rows."""
    w = weight() if w is None else w
    return F.sum(F.when(x.isNotNull(), w).otherwise(F.lit(0)))


def wcount_if(cond: Column, w: Column | None = None) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) over the fanned-out rows."""
    w = weight() if w is None else w
    return F.sum(F.when(F.coalesce(cond, F.lit(False)), w).otherwise(F.lit(0)))


def first_of(*keys: str, by: str) -> Column:
    """1 in one row of every group of equal ``keys``, else 0: its sum counts distinct groups.

    The rows are sorted by the keys, with spilling, and numbered as they pass; no hash table holds a task's groups.
    """
    return (F.row_number().over(W.partitionBy(*keys).orderBy(by)) == 1).cast("int")


def item_value() -> Column:
    return F.col("price") + F.col("freight_value")
