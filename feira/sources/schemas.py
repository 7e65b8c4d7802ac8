"""Fixed schemas. No ``inferSchema``: inference costs an extra pass and gives unstable types.

Raw schemas describe the nine source CSV files as they arrive (timestamps as
text, parsed leniently during preparation). Prepared schemas describe what
the preparation step writes and what the views read. Money is DECIMAL(12,2)
so sums are exact and independent of partition order.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, TS, B = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType()
MONEY = T.DecimalType(12, 2)


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Fixed values that must equal the source's: the nine raw CSV file names of the public
# marketplace dataset, keyed by the logical table name.
RAW_FILES = {
    "customers": "olist_customers_dataset.csv",
    "geoloc": "olist_geolocation_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "categories": "product_category_name_translation.csv",
}

RAW = {
    "customers": _schema(
        ("customer_id", S), ("customer_unique_id", S), ("customer_city", S), ("customer_state", S)
    ),
    "geoloc": _schema(
        ("geolocation_zip_code_prefix", S), ("geolocation_lat", D), ("geolocation_lng", D),
        ("geolocation_city", S),
    ),
    "order_items": _schema(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", S), ("price", MONEY), ("freight_value", MONEY),
    ),
    "order_payments": _schema(
        ("order_id", S), ("payment_type", S), ("payment_installments", I), ("payment_value", MONEY)
    ),
    "order_reviews": _schema(
        ("order_id", S), ("review_score", I), ("review_comment_title", S),
        ("review_comment_message", S), ("review_creation_date", S), ("review_answer_timestamp", S),
    ),
    "orders": _schema(
        ("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", S),
        ("order_approved_at", S), ("order_delivered_carrier_date", S),
        ("order_delivered_customer_date", S), ("order_estimated_delivery_date", S),
    ),
    "products": _schema(
        ("product_id", S), ("product_category_name", S), ("product_name_lenght", D),
        ("product_description_lenght", D), ("product_photos_qty", D), ("product_weight_g", D),
        ("product_length_cm", D), ("product_height_cm", D), ("product_width_cm", D),
    ),
    "sellers": _schema(("seller_id", S), ("seller_city", S), ("seller_state", S)),
    "categories": _schema(("product_category_name", S), ("product_category_name_english", S)),
}

# Timestamp columns parsed leniently during preparation, per raw table.
RAW_TIMESTAMPS = {
    "order_items": ["shipping_limit_date"],
    "order_reviews": ["review_creation_date", "review_answer_timestamp"],
    "orders": [
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    ],
}

PREPARED = {
    "customers": RAW["customers"],
    "geoloc": _schema(("geolocation_zip_code_prefix", S), ("geolocation_lat", D), ("geolocation_lng", D)),
    "order_items": _schema(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", TS), ("price", MONEY), ("freight_value", MONEY),
    ),
    "order_payments": RAW["order_payments"],
    "order_reviews": _schema(
        ("order_id", S), ("review_score", I), ("review_comment_message", S),
        ("review_creation_date", TS), ("review_answer_timestamp", TS),
    ),
    "orders": _schema(
        ("order_id", S), ("customer_id", S), ("order_status", S), ("order_purchase_timestamp", TS),
        ("order_approved_at", TS), ("order_delivered_carrier_date", TS),
        ("order_delivered_customer_date", TS), ("order_estimated_delivery_date", TS),
        ("dq_invalid_approval_null", B), ("dq_invalid_carrier_null", B), ("dq_invalid_delivery_null", B),
    ),
    "products": _schema(
        ("product_id", S), ("category_name", S), ("weight_g", D), ("length_cm", D),
        ("height_cm", D), ("width_cm", D), ("photos_qty", D),
    ),
    "sellers": RAW["sellers"],
    "categories": RAW["categories"],
}
