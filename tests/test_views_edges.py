"""Edge cases on hand-made tables: each view in Spark vs the same view's SQL in DuckDB.

The tables cover what the bridged test data never reaches: prices on the
bucket boundaries and NULL, every delay bucket edge and a 23:00 -> 01:00
midnight crossing, an order with two items and two reviews (fan-out), a
month without sales, a bucket with a single review, a seller without
reviews, an order without items and a NULL person.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from duck_oracle.views import VIEWS as VIEW_SQL
from feira.sources.bridge import Tables
from tests.compare import assert_same

D = Decimal
T0 = dt.datetime(2018, 1, 10, 12, 0)

SCHEMAS = {
    "fx_orders": [("order_id", "bigint"), ("customer_id", "bigint"), ("order_status", "string"),
                  ("order_purchase_timestamp", "timestamp"), ("order_approved_at", "timestamp"),
                  ("order_delivered_carrier_date", "timestamp"), ("order_delivered_customer_date", "timestamp"),
                  ("order_estimated_delivery_date", "timestamp")],
    "fx_order_items": [("order_id", "bigint"), ("order_item_id", "int"), ("product_id", "bigint"),
                       ("seller_id", "bigint"), ("price", "decimal(12,2)"), ("freight_value", "decimal(12,2)")],
    "fx_order_reviews": [("order_id", "bigint"), ("review_score", "int")],
    "fx_order_payments": [("order_id", "bigint"), ("payment_type", "string"), ("payment_installments", "int"),
                          ("payment_value", "decimal(12,2)")],
    "fx_customers": [("customer_id", "bigint"), ("customer_unique_id", "bigint"), ("customer_city", "string"),
                     ("customer_state", "string")],
    "fx_products": [("product_id", "bigint"), ("category_name", "string")],
    "fx_sellers": [("seller_id", "bigint"), ("seller_city", "string"), ("seller_state", "string")],
}


def _days(n, h=0):
    return dt.timedelta(days=n, hours=h)


def _rows():
    orders, items, reviews, payments, customers = [], [], [], [], []
    prices = [D("49.99"), D("50"), D("99.99"), D("100"), D("249.99"), D("250"), D("499.99"), D("500"), D("500.01"), None]
    delays = [-8, -7, -6, -1, 0, 1, 3, 4, 7, 8]
    oid = 0
    for k, (price, delay) in enumerate(zip(prices, delays)):
        oid += 1
        month = [0, 31, 90][k % 3]  # January, February, April (no March)
        purchase = T0 + _days(month)
        est = purchase + _days(10)
        orders.append((oid, oid, "delivered", purchase, purchase + _days(0, 1), purchase + _days(1),
                       est + _days(delay), est))
        items.append((oid, 1, 100 + k % 3, 7 + k % 2, price, D("10.50")))
        reviews.append((oid, 1 + k % 5))
        payments.append((oid, ["credit_card", "boleto"][k % 2], k % 4, price if price is not None else D("1.00")))
        customers.append((oid, 900 + k % 4, "city", ["SP", "RJ"][k % 2]))
    # Fan-out: one order, two items, two reviews (one NULL score).
    oid += 1
    orders.append((oid, oid, "delivered", T0, T0, T0 + _days(1), T0 + _days(5), T0 + _days(4)))
    items += [(oid, 1, 100, 7, D("30.00"), D("5.00")), (oid, 2, 101, 9, D("70.00"), D("6.00"))]
    reviews += [(oid, 5), (oid, None), (oid, 2)]
    payments += [(oid, "voucher", 1, D("20.00")), (oid, "credit_card", 3, D("91.00"))]
    customers.append((oid, 900, "city", "SP"))
    # Midnight crossing: delivered 01:00 the day after an estimate at 23:00.
    oid += 1
    est = dt.datetime(2018, 2, 3, 23, 0)
    orders.append((oid, oid, "delivered", T0 + _days(20), None, None, est + _days(0, 2), est))
    items.append((oid, 1, 102, 9, D("250.00"), D("1.00")))
    reviews.append((oid, 3))
    payments.append((oid, "boleto", 1, D("251.00")))
    customers.append((oid, None, "city", "MG"))  # NULL person
    # Order without items, a canceled order, a delivered order without delivery date.
    for status, delivered in [("delivered", T0 + _days(3)), ("canceled", None), ("delivered", None)]:
        oid += 1
        orders.append((oid, oid, status, T0 + _days(2), T0, None, delivered, T0 + _days(9)))
        customers.append((oid, 901, "city", "RJ"))
        if status == "canceled" or delivered is None:
            items.append((oid, 1, 100, 11, D("15.00"), D("2.00")))  # seller 11: no reviews at all
    products = [(100, "cat_a"), (101, "cat_b"), (102, "cat_a")]
    sellers = [(7, "c7", "S1"), (9, "c9", "S2"), (11, "c11", "S3")]
    return {
        "fx_orders": orders, "fx_order_items": items, "fx_order_reviews": reviews,
        "fx_order_payments": payments, "fx_customers": customers, "fx_products": products, "fx_sellers": sellers,
    }


def _spark_ddl(cols):
    return ", ".join(f"{c} {'timestamp_ntz' if t == 'timestamp' else t}" for c, t in cols)


def _duck_ddl(cols):
    return ", ".join(f"{c} {'varchar' if t == 'string' else t}" for c, t in cols)


@pytest.fixture(scope="module")
def edge_tables(spark):
    data = _rows()
    con = duckdb.connect()
    frames = {}
    for name, cols in SCHEMAS.items():
        con.execute(f"CREATE TABLE {name} ({_duck_ddl(cols)})")
        if data[name]:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(cols))})", data[name])
        frames[name] = spark.createDataFrame(data[name], _spark_ddl(cols))
    t = Tables(
        orders=frames["fx_orders"], order_items=frames["fx_order_items"], order_reviews=frames["fx_order_reviews"],
        order_payments=frames["fx_order_payments"], customers=frames["fx_customers"],
        products=frames["fx_products"], sellers=frames["fx_sellers"],
    )
    return t, con


@pytest.mark.parametrize("key", sorted(entry._VIEW_KEYS))
def test_view_on_edge_tables(edge_tables, key):
    t, con = edge_tables
    got = entry.normalise(entry._VIEW_KEYS[key](t)).toPandas()
    want = con.sql(VIEW_SQL[key]).df()
    assert_same(got, want, key)


def test_edge_expectations(edge_tables):
    t, _ = edge_tables
    buckets = {(r.price_bucket, r.bucket_order) for r in entry._VIEW_KEYS["v03_price_review_correlation"](t).collect()}
    assert ("R$50–100", 3) in buckets and ("R$100–250", 4) in buckets and ("R$250–500", 5) in buckets
    assert ("Over R$500", 5) in buckets  # includes the NULL price
    delay = {r.delay_bucket: r.order_count for r in entry._VIEW_KEYS["v15_delay_vs_review"](t).collect()}
    assert set(delay) == {"Very Early (7d+)", "Early (1-6d)", "On Time", "Slightly Late (1-3d)", "Late (4-7d)",
                          "Very Late (7d+)"}
    months = entry._VIEW_KEYS["v01_revenue_trends"](t).orderBy("month_start").collect()
    assert [str(r.month_start) for r in months] == ["2018-01-01", "2018-02-01", "2018-04-01"]
    assert months[2].prev_month_revenue == months[1].gross_revenue  # LAG by row: April follows February
    segments = {r.rfm_segment for r in entry._VIEW_KEYS["v06_rfm_segments"](t).collect()}
    assert "Cannot Lose Them" not in segments
