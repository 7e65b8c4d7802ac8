"""V-05's activity bitsets: any number of months, outlying dates, undated orders, hot persons and the plan."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest

from feira.plans.customers import activity_bitsets, active_months, cohort_retention, words_of
from feira.sources.bridge import Tables


def brute(orders, person_of):
    """(cohort month, month number) -> (active persons, cohort size); a month is (year, month) or None."""
    active: dict[int, set] = {}
    for _, customer, status, at in orders:
        if status == "delivered" and person_of.get(customer) is not None:
            active.setdefault(person_of[customer], set()).add(None if at is None else at.year * 12 + at.month - 1)
    cells = Counter()
    for months in active.values():
        dated = [m for m in months if m is not None]
        first = min(dated, default=None)
        for m in months:
            cells[first, None if m is None or first is None else m - first] += 1
    return {(c, n): (k, cells.get((c, 0)) if c is not None else None) for (c, n), k in cells.items()}


def tables(spark, orders, customers):
    o = spark.createDataFrame(orders, "order_id bigint, customer_id bigint, order_status string, order_purchase_timestamp timestamp_ntz")
    c = spark.createDataFrame(customers, "customer_id bigint, customer_unique_id bigint")
    return Tables(orders=o, customers=c, order_items=None, order_reviews=None, order_payments=None, products=None, sellers=None)


def cells(df):
    out = {}
    for r in df.collect():
        cohort = None if r.cohort_month is None else r.cohort_month.year * 12 + r.cohort_month.month - 1
        assert (cohort, r.month_number) not in out
        out[cohort, r.month_number] = (r.active_customers, r.cohort_customers)
    return out


def made(rng, n, first, last, undated=0.0):
    orders, customers = [], []
    for i in range(n):
        day = None if rng.random() < undated else dt.datetime(rng.randint(first, last), rng.randint(1, 12), rng.randint(1, 28), 12)
        # person 0 holds a third of the orders
        person = None if i % 50 == 7 else 0 if i % 3 == 0 else rng.randint(1, max(1, n // 6))
        customers.append((i, person))
        orders.append((i, i, rng.choice(["delivered", "delivered", "delivered", "canceled"]), day))
    return orders, customers


@pytest.mark.parametrize("first, last, undated", [(2017, 2018, 0.0), (1995, 2024, 0.0), (2016, 2018, 0.2)])
def test_cells_against_sets_of_months(spark, first, last, undated):
    orders, customers = made(random.Random(first), 600, first, last, undated)
    assert cells(cohort_retention(tables(spark, orders, customers))) == brute(orders, dict(customers))


def test_word_edges_and_an_outlying_date(spark):
    edge = 64 * 378  # a word begins at this month, and the 64th bit of the one before is its last month
    at = [dt.datetime(m // 12, m % 12 + 1, 15) for m in (edge - 1, edge, edge + 63, edge + 64)] + [dt.datetime(1, 1, 1), dt.datetime(9999, 12, 31)]
    orders = [(i, i, "delivered", d) for i, d in enumerate(at * 3)]
    customers = [(i, [1, 2, 3][i // len(at)] if i % 2 else 1) for i in range(len(orders))]
    t = tables(spark, orders, customers)
    assert cells(cohort_retention(t)) == brute(orders, dict(customers))


def test_no_delivered_orders_and_only_undated_ones(spark):
    assert cells(cohort_retention(tables(spark, [(1, 1, "canceled", dt.datetime(2018, 1, 1))], [(1, 1)]))) == {}
    orders = [(1, 1, "delivered", None), (2, 2, "delivered", None)]
    assert cells(cohort_retention(tables(spark, orders, [(1, 1), (2, 1)]))) == {(None, None): (1, None)}


def test_bitsets_of_any_key(spark):
    rows = [("a", 5), ("a", 5), ("a", 64), ("b", 127), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, month bigint")
    words = words_of(df, "month")
    assert words == [0, 1]
    got = {r.k: r.active for r in activity_bitsets(df, "k", "month", words).select("k", active_months(words).alias("active")).collect()}
    assert got == {"a": [5, 64], "b": [127, None], "c": [None]}


def test_no_shuffle_by_person_and_month(spark):
    orders, customers = made(random.Random(3), 300, 2017, 2018)
    plan = cohort_retention(tables(spark, orders, customers))._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "customer_unique_id" not in plan[plan.index("Window"):].split("\n")[0]  # the only window is the cohort's
    assert plan.count("Window [") == 1 and "partial_bit_or" in plan
