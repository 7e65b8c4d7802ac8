"""The notebook's profiling and preparation steps as queries over the tables.

Each function applies one operator from ``feira.operators.profile`` /
``feira.operators.prepare`` to the table the notebook applies it to, over the
whole table. They read the raw sources (``*_raw``, and the tables that need no
preparation) and apply the operator at query time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.operators import prepare, profile
from feira.sources.bridge import Tables

# (reported name, Tables attribute) of the nine raw sources.
RAW_SOURCES = [
    ("customers", "customers"),
    ("geolocation", "geolocation_raw"),
    ("order_items", "order_items_raw"),
    ("order_payments", "order_payments"),
    ("order_reviews", "order_reviews_raw"),
    ("orders", "orders_raw"),
    ("products", "products_raw"),
    ("sellers", "sellers"),
    ("categories", "categories"),
]
# Fixed values that must equal the reference's: the columns each step works on.
ORDER_DATES = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"]
PRODUCT_NUMERIC = [
    "product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g",
    "product_length_cm", "product_height_cm", "product_width_cm",
]
GEO_KEY = ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def source_shapes(t: Tables) -> DataFrame:
    """P-01 for the nine raw sources."""
    return _union([profile.shape(getattr(t, attr), name) for name, attr in RAW_SOURCES])


def orders_info(t: Tables) -> DataFrame:
    """P-03 ``orders.info()``."""
    return profile.info(t.orders_raw)


def products_nulls(t: Tables) -> DataFrame:
    """P-04 ``products.isnull().sum()``."""
    return profile.null_counts(t.products_raw)


def products_nunique(t: Tables) -> DataFrame:
    """P-06 ``products.nunique()``."""
    return profile.distinct_counts(t.products_raw)


def payment_types(t: Tables) -> DataFrame:
    """P-07 ``order_payments['payment_type'].unique()``."""
    return profile.unique_values(t.order_payments, "payment_type")


def source_duplicates(t: Tables) -> DataFrame:
    """P-08 ``duplicated().sum()`` for the nine raw sources."""
    return _union(
        [profile.duplicate_rows(getattr(t, attr)).select(F.lit(name).alias("table_name"), "duplicate_rows")
         for name, attr in RAW_SOURCES]
    )


def key_duplicates(t: Tables) -> DataFrame:
    """P-09: duplicated (zip, lat, lng) before and after centroids, duplicated payment order ids."""
    cases = [
        ("geolocation", t.geolocation_raw, GEO_KEY),
        ("geoloc_clean", prepare.geo_centroids(t.geolocation_raw), GEO_KEY),
        ("order_payments", t.order_payments, ["order_id"]),
    ]
    return _union(
        [profile.duplicate_rows(df, keys).select(F.lit(name).alias("table_name"), "duplicate_rows")
         for name, df, keys in cases]
    )


def status_counts(t: Tables) -> DataFrame:
    """P-10 ``orders['order_status'].value_counts()``."""
    return profile.value_counts(t.orders_raw, "order_status")


def null_status(t: Tables) -> DataFrame:
    """P-11 statuses behind the NULLs of the three order dates."""
    return profile.null_status_profile(t.orders_raw, ORDER_DATES)


def describe_numeric(t: Tables, digits: int | None = 6) -> DataFrame:
    """P-12 ``order_items['price'].describe()`` and ``products.describe()``."""
    return _union(
        [
            profile.describe(t.order_items_raw, ["price"], digits).select(
                F.lit("order_items").alias("table_name"), "*"
            ),
            profile.describe(t.products_raw, PRODUCT_NUMERIC, digits).select(
                F.lit("products").alias("table_name"), "*"
            ),
        ]
    )


def price_freight_corr(t: Tables, digits: int | None = 8) -> DataFrame:
    """P-13 ``order_items[['price','freight_value']].corr()``."""
    return profile.correlation_matrix(t.order_items_raw, ["price", "freight_value"], digits)


def products_corr(t: Tables, digits: int | None = 8) -> DataFrame:
    """P-14 correlation matrix of the seven numeric product columns."""
    return profile.correlation_matrix(t.products_raw, PRODUCT_NUMERIC, digits)


def price_histogram(t: Tables) -> DataFrame:
    """P-15 ``order_items['price'].hist()`` (10 bins)."""
    return profile.histogram(t.order_items_raw, "price", 10)


def orders_head(t: Tables) -> DataFrame:
    """P-16 ``orders.head()`` in order-id order."""
    return profile.head(t.orders_raw, 5, ["order_id"])


def orders_sample(t: Tables) -> DataFrame:
    """P-17 ``orders.sample(5)``."""
    return profile.sample_rows(t.orders_raw, 5, "order_id")


def timeline_errors(t: Tables) -> DataFrame:
    """P-18 timeline validation of orders."""
    return profile.timeline_violations(t.orders_raw)


def geo_dedup(t: Tables) -> DataFrame:
    """C-02 ``geoloc.drop_duplicates()``."""
    return prepare.dedup_rows(t.geolocation_raw)


def payments_keep_first(t: Tables) -> DataFrame:
    """C-03 ``drop_duplicates(subset=...)`` keep-first, on the payment table (many rows per order)."""
    return prepare.dedup_keep_first(t.order_payments, ["order_id"])


def geo_centroids(t: Tables) -> DataFrame:
    """C-04 centroid per zip prefix."""
    return prepare.geo_centroids(t.geolocation_raw)


def items_lenient_ts(t: Tables) -> DataFrame:
    """C-05 ``to_datetime(shipping_limit_date, errors='coerce')``."""
    return prepare.parse_timestamps(t.order_items_raw, ["shipping_limit_date"]).select(
        "order_id", "order_item_id", "shipping_limit_date"
    )


def reviews_filled(t: Tables) -> DataFrame:
    """C-06 review comment default."""
    return prepare.fill_comment(t.order_reviews_raw).select("order_id", "review_score", "review_comment_message")


def products_filled(t: Tables) -> DataFrame:
    """C-07..C-09 product fills (category default, zeros, category medians)."""
    return prepare.fill_products(t.products_raw)


def orders_dq_flags(t: Tables) -> DataFrame:
    """C-10..C-12 the three status-aware DQ flags."""
    return prepare.add_dq_flags(t.orders_raw).select(
        "order_id", "order_status", *[flag for flag, _, _ in prepare.DQ_RULES]
    )


def orders_null_policy(t: Tables) -> DataFrame:
    """C-13 expected vs invalid NULLs per date column and status."""
    return prepare.null_policy_report(t.orders_raw)


def dim_products(t: Tables) -> DataFrame:
    """C-14..C-18 the product dimension."""
    return prepare.dim_products(t.products_raw, t.categories)
