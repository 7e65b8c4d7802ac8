"""Invariants of the views, on the bridged sf0.001 tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def q(spark):
    queries = entry.queries()
    return lambda key: queries[key](spark, SF_SMALL).collect()


def test_shares_sum_to_hundred(q):
    for key, col in [("v04_repeat_purchase_rate", "pct_of_customers"), ("v02_category_performance", "revenue_share_pct"),
                     ("v12_revenue_by_state", "revenue_share_pct"), ("m05_payment_revenue_share", "revenue_share_pct")]:
        rows = q(key)
        assert abs(sum(r[col] for r in rows) - 100) <= 0.01 * len(rows), key


def test_cumulative_share_ends_at_hundred(q):
    rows = sorted(q("v02_category_performance"), key=lambda r: r.cumulative_revenue_pct)
    assert rows[-1].cumulative_revenue_pct == 100.0
    assert [r.pareto_group for r in rows].count("Top 80%") >= 1


def test_month_zero_retention_is_full(q):
    assert all(r.retention_rate_pct == 100.0 for r in q("v05_cohort_retention") if r.month_number == 0)
    assert all(r.retention_rate_pct == 100.0 for r in q("m07_retention_matrix") if r.month_number == 0)


def test_on_time_plus_late_at_most_total(q):
    assert all(r.on_time + r.late <= r.total_orders for r in q("v13_delivery_performance_monthly"))


def test_unreachable_segment_never_appears(q):
    assert all(r.rfm_segment != "Cannot Lose Them" for r in q("v06_rfm_segments"))
    assert all(r.rfm_total == r.r_score + r.f_score + r.m_score for r in q("v06_rfm_segments"))


def test_ltv_segments_are_rfm_segments(q):
    assert {r.rfm_segment for r in q("v07_customer_ltv")} <= {r.rfm_segment for r in q("v06_rfm_segments")}


def test_seller_ranks_and_tiles_in_range(q):
    rows = q("v08_seller_performance")
    n = len(rows)
    assert all(1 <= r.revenue_rank <= n and 1 <= r.revenue_quartile <= 4 for r in rows)
    assert all(1.0 <= r.seller_health_score <= 5.0 for r in rows)
