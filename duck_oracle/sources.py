"""Oracle SQL of the source, sink and catalog queries: every column of every table, and every published view."""

from __future__ import annotations

from duck_oracle.quality import QUALITY
from duck_oracle.views import VIEWS

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
TEXT, LONG, REAL = "cast({c} AS varchar)", "cast({c} AS bigint)", "cast({c} AS double)"


def _select(view: str, **columns: str) -> str:
    """The named columns of ``view``, each through its type's form (``{c}`` is the column) or as given SQL."""
    return "SELECT " + ", ".join(f"{form.format(c=name)} AS {name}" for name, form in columns.items()) + f" FROM {view}"


CUSTOMERS = _select("fx_customers", customer_id=TEXT, customer_unique_id=TEXT, customer_city=TEXT, customer_state=TEXT)
PAYMENTS = _select("fx_order_payments", order_id=TEXT, payment_type=TEXT, payment_installments=LONG, payment_value=REAL)
SELLERS = _select("fx_sellers", seller_id=TEXT, seller_city=TEXT, seller_state=TEXT)
CATEGORIES = _select("fx_categories", product_category_name=TEXT, product_category_name_english=TEXT)
ITEM = {"order_id": TEXT, "order_item_id": LONG, "product_id": TEXT, "seller_id": TEXT, "price": REAL, "freight_value": REAL}
ORDER = {"order_id": TEXT, "customer_id": TEXT, "order_status": TEXT, "order_purchase_timestamp": TS, "order_approved_at": TS,
         "order_delivered_carrier_date": TS, "order_delivered_customer_date": TS, "order_estimated_delivery_date": TS}
PRODUCT_NUMBERS = ["product_name_lenght", "product_description_lenght", "product_photos_qty", "product_weight_g",
                   "product_length_cm", "product_height_cm", "product_width_cm"]

RAW = {
    "s01_customers_csv": CUSTOMERS,
    "s02_geolocation_csv": _select(
        "fx_geolocation", geolocation_zip_code_prefix=TEXT, geolocation_lat=REAL, geolocation_lng=REAL, geolocation_city=TEXT),
    "s03_order_items_csv": _select("fx_order_items", **ITEM, shipping_limit_date=TEXT),
    "s04_order_payments_csv": PAYMENTS,
    "s05_order_reviews_csv": _select(
        "fx_order_reviews", order_id=TEXT, review_score=REAL, review_comment_title="cast(NULL AS varchar)", review_comment_message=TEXT,
        review_creation_date="strftime(review_creation_date, '%Y-%m-%d %H:%M:%S')", review_answer_timestamp="cast(NULL AS varchar)"),
    "s06_orders_csv": _select("fx_orders", **ORDER),
    "s07_products_csv": _select("fx_products_raw", product_id=TEXT, product_category_name=TEXT, **dict.fromkeys(PRODUCT_NUMBERS, REAL)),
    "s08_sellers_csv": SELLERS,
    "s09_categories_csv": CATEGORIES,
}

PREPARED = {
    "s10_customers": CUSTOMERS,
    "s10_geoloc": "SELECT cast(geolocation_zip_code_prefix AS varchar) AS geolocation_zip_code_prefix, geolocation_lat, geolocation_lng "
                  f"FROM ({QUALITY['c04_geo_centroids']}) g",
    "s10_order_items": _select("fx_order_items", **ITEM, shipping_limit_date=TS.format(c="try_cast(shipping_limit_date AS timestamp)")),
    "s10_order_payments": PAYMENTS,
    "s10_order_reviews": _select(
        "fx_order_reviews", order_id=TEXT, review_score=REAL, review_comment_message="coalesce({c}, 'NO COMMENT')",
        review_creation_date=TS, review_answer_timestamp="cast(NULL AS varchar)"),
    "s10_orders": f"SELECT o.*, f.dq_invalid_approval_null, f.dq_invalid_carrier_null, f.dq_invalid_delivery_null "
                  f"FROM ({_select('fx_orders', **ORDER)}) o JOIN ({QUALITY['c10_12_orders_dq_flags']}) f ON o.order_id = cast(f.order_id AS varchar)",
    "s10_products": f"SELECT p.* REPLACE (cast(product_id AS varchar) AS product_id) FROM ({QUALITY['c18_dim_products']}) p",
    "s10_sellers": SELLERS,
    "s10_categories": CATEGORIES,
}

PUBLISHED = {f"s12_vw_{key.split('_', 1)[1]}": sql for key, sql in VIEWS.items()}

REFRESHED = {
    "s11_refreshed_revenue_trends": VIEWS["v01_revenue_trends"],
    "s11_refreshed_payment_methods": VIEWS["v10_payment_method_analysis"],
    "s11_refreshed_monthly_payments": VIEWS["v11_monthly_revenue_by_payment"],
}

SOURCES = {**RAW, **PREPARED, **REFRESHED, **PUBLISHED}
