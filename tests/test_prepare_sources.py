"""Preparation operators on hand-made frames, and the CSV source/sink round trip."""

from __future__ import annotations

import csv
import datetime as dt
import os
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from feira.operators import prepare, profile
from feira.sources import csv_io
from feira.sources.schemas import RAW_FILES


def test_dq_flags_are_never_null(spark):
    ts = dt.datetime(2018, 1, 1)
    rows = [(None, None, None, None), ("delivered", None, None, None), ("delivered", ts, ts, ts),
            ("shipped", ts, None, None), ("canceled", None, None, None)]
    df = spark.createDataFrame(rows, "order_status string, order_approved_at timestamp_ntz, "
                                     "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz")
    got = [tuple(r) for r in prepare.add_dq_flags(df).select(
        "dq_invalid_approval_null", "dq_invalid_carrier_null", "dq_invalid_delivery_null").collect()]
    assert got == [(False, False, False), (True, True, True), (False, False, False), (False, True, False),
                   (False, False, False)]


def test_median_fill_by_group(spark):
    rows = [("a", 1.0), ("a", None), ("a", 4.0), ("a", 10.0), ("b", None), ("b", None), (None, None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = sorted(((r.g, r.x) for r in prepare.fill_median_by_group(df, "g", ["x"]).collect()), key=str)
    # a: median of 1, 4, 10 = 4; b stays NULL (all-NULL group); a NULL key is no group (pandas drops NaN keys).
    want = [("a", 1.0), ("a", 4.0), ("a", 4.0), ("a", 10.0), ("b", None), ("b", None), (None, None), (None, 2.0)]
    assert got == sorted(want, key=str)


def test_median_interpolates_even_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 20.0), ("a", None)], "g string, x double")
    filled = [r.x for r in prepare.fill_median_by_group(df, "g", ["x"]).collect()]
    assert sorted(filled) == [1.0, 2.0, 6.0, 10.0, 20.0]


def test_dedup_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, None, 5), (2, "z", 1)], "k int, s string, v int")
    got = sorted(tuple(r) for r in prepare.dedup_keep_first(df, ["k"]).collect())
    assert got == [(1, None, 5), (2, "z", 1)]


def test_geo_centroids_drop_null_zip_and_duplicates(spark):
    df = spark.createDataFrame(
        [("01", 1.0, 2.0, "x"), ("01", 1.0, 2.0, "x"), ("01", 3.0, 4.0, "x"), (None, 5.0, 5.0, "y")],
        "geolocation_zip_code_prefix string, geolocation_lat double, geolocation_lng double, geolocation_city string",
    )
    got = [tuple(r) for r in prepare.geo_centroids(df).collect()]
    assert got == [("01", 2.0, 3.0)]


def test_duplicate_rows_treats_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "a")], "a int, b string")
    assert profile.duplicate_rows(df).first().duplicate_rows == 2
    assert profile.duplicate_rows(df, ["a"]).first().duplicate_rows == 2


def _write_csv(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh, quoting=csv.QUOTE_MINIMAL, doublequote=True)
        w.writerow(header)
        w.writerows(rows)


def test_raw_csv_to_prepared_round_trip(spark):
    src = tempfile.mkdtemp(prefix="feira-raw-")
    out = tempfile.mkdtemp(prefix="feira-prepared-")
    tricky = 'Ótimo, "chegou" rápido\nrecomendo'
    files = {
        "customers": (["customer_id", "customer_unique_id", "customer_city", "customer_state"],
                      [["c1", "u1", "sao paulo", "SP"]]),
        "geoloc": (["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city"],
                   [["01037", "-23.5", "-46.6", "sao paulo"], ["01037", "-23.5", "-46.6", "sao paulo"]]),
        "order_items": (["order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
                         "freight_value"],
                        [["o1", "1", "p1", "s1", "2018-01-05 10:00:00", "58.90", "13.29"],
                         ["o1", "2", "p1", "s1", "not a date", "58.90", "13.29"]]),
        "order_payments": (["order_id", "payment_type", "payment_installments", "payment_value"],
                           [["o1", "credit_card", "2", "144.38"]]),
        "order_reviews": (["order_id", "review_score", "review_comment_title", "review_comment_message",
                           "review_creation_date", "review_answer_timestamp"],
                          [["o1", "5", "", tricky, "2018-01-10 00:00:00", "2018-01-11 12:00:00"],
                           ["o1", "4", "t", "", "2018-01-12 00:00:00", ""]]),
        "orders": (["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
                    "order_delivered_carrier_date", "order_delivered_customer_date",
                    "order_estimated_delivery_date"],
                   [["o1", "c1", "delivered", "2018-01-02 09:00:00", "", "2018-01-03 10:00:00",
                     "2018-01-08 10:00:00", "2018-01-20 00:00:00"]]),
        "products": (["product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
                      "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm",
                      "product_width_cm"],
                     [["p1", "", "40", "", "1", "500", "", "10", "20"],
                      ["p2", "", "40", "300", "", "", "30", "12", "22"]]),
        "sellers": (["seller_id", "seller_city", "seller_state"], [["s1", "campinas", "SP"]]),
        "categories": (["product_category_name", "product_category_name_english"], [["perfumaria", "perfumery"]]),
    }
    for name, (header, rows) in files.items():
        _write_csv(os.path.join(src, RAW_FILES[name]), header, rows)

    prepared = csv_io.prepare_tables(csv_io.raw_tables(spark, src))
    csv_io.write_prepared(prepared, out, fmt="csv")
    back = csv_io.read_prepared(spark, out, fmt="csv")

    reviews = {r.review_score: r for r in back.order_reviews.collect()}
    assert reviews[5].review_comment_message == tricky
    assert reviews[4].review_comment_message == "NO COMMENT"
    assert reviews[4].review_answer_timestamp is None
    items = sorted(back.order_items.collect(), key=lambda r: r.order_item_id)
    assert items[0].shipping_limit_date == dt.datetime(2018, 1, 5, 10, 0) and items[1].shipping_limit_date is None
    assert items[0].price == Decimal("58.90")
    order = back.orders.first()
    assert order.dq_invalid_approval_null is True and order.dq_invalid_delivery_null is False
    assert back.geoloc.count() == 1
    products = {r.product_id: r for r in back.products.collect()}
    assert products["p1"].category_name == "Unknown"  # 'Uncategorized' has no translation
    assert products["p1"].length_cm == 30.0 and products["p2"].weight_g == 500.0  # medians of the group
    assert products["p2"].photos_qty == 0.0
    assert set(back.customers.columns) >= {"customer_unique_id"}

    csv_io.write_prepared(prepared, out + "-pq")
    again = csv_io.read_prepared(spark, out + "-pq")
    assert again.order_reviews.filter(F.col("review_score") == 5).first().review_comment_message == tricky


def test_csv_columns_bind_by_header(spark, tmp_path):
    """Reordered and undeclared columns: declared ones keep name and type, others stay as text, for every source."""
    from feira.sources.schemas import RAW

    for name, file in RAW_FILES.items():
        declared = [f.name for f in RAW[name].fields]
        header = ["extra_first", *reversed(declared), "extra_last"]
        values = {f.name: "7" if f.dataType.typeName() != "string" else f"text {f.name}" for f in RAW[name].fields}
        folder = tmp_path / name
        folder.mkdir()
        _write_csv(os.path.join(folder, file), header, [["a", *[values[c] for c in reversed(declared)], "b"]] * 2)
        df = csv_io.read_raw_csv(spark, str(folder), name)
        assert df.columns == header
        row = df.first().asDict()
        assert (row["extra_first"], row["extra_last"]) == ("a", "b")
        assert all(str(row[c]) == values[c] or float(row[c]) == 7 for c in declared)
        assert profile.duplicate_rows(df).first()[0] == 1


def test_csv_missing_column_is_an_error(spark, tmp_path):
    import pytest

    _write_csv(os.path.join(tmp_path, RAW_FILES["sellers"]), ["seller_id", "seller_city"], [["1", "x"]])
    with pytest.raises(ValueError, match="seller_state"):
        csv_io.read_raw_csv(spark, str(tmp_path), "sellers")


def test_csv_files_of_different_headers_fail(spark, tmp_path):
    import pytest

    folder = tmp_path / RAW_FILES["sellers"]
    folder.mkdir()
    _write_csv(os.path.join(folder, "a.csv"), ["seller_id", "seller_city", "seller_state"], [["1", "x", "S"]])
    _write_csv(os.path.join(folder, "b.csv"), ["seller_city", "seller_id", "seller_state"], [["y", "2", "T"]])
    with pytest.raises(Exception, match="(?i)header"):
        csv_io.read_raw_csv(spark, str(tmp_path), "sellers").collect()
