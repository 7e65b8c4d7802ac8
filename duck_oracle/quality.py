"""Oracle SQL for the profiling (P-*), preparation (C-*) and catalog (S-13) queries."""

from __future__ import annotations

from duck_oracle.sqlfn import RD
from duck_oracle.views import V01

TS_FMT = "'%Y-%m-%d %H:%M:%S'"


def TS(x: str) -> str:
    return f"strftime({x}, {TS_FMT})"


# Raw source columns (reported table name, fixture view, columns).
RAW = [
    ("customers", "fx_customers", ["customer_id", "customer_unique_id", "customer_city", "customer_state"]),
    ("geolocation", "fx_geolocation",
     ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city"]),
    ("order_items", "fx_order_items",
     ["order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value", "shipping_limit_date"]),
    ("order_payments", "fx_order_payments", ["order_id", "payment_type", "payment_installments", "payment_value"]),
    ("order_reviews", "fx_order_reviews", ["order_id", "review_score", "review_comment_message", "review_creation_date"]),
    ("orders", "fx_orders",
     ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
      "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]),
    ("products", "fx_products_raw",
     ["product_id", "product_category_name", "product_name_lenght", "product_description_lenght",
      "product_photos_qty", "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]),
    ("sellers", "fx_sellers", ["seller_id", "seller_city", "seller_state"]),
    ("categories", "fx_categories", ["product_category_name", "product_category_name_english"]),
]
COLS = {name: cols for name, _, cols in RAW}
ORDER_TYPES = ["bigint", "bigint", "string"] + ["timestamp_ntz"] * 5
PRODUCT_NUMERIC = COLS["products"][2:]
ORDER_DATES = ["order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date"]
GEO_KEY = ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng"]

GEO_CENTROIDS = """
SELECT geolocation_zip_code_prefix, avg(geolocation_lat) AS geolocation_lat, avg(geolocation_lng) AS geolocation_lng
FROM (SELECT DISTINCT * FROM fx_geolocation) d
WHERE geolocation_zip_code_prefix IS NOT NULL
GROUP BY geolocation_zip_code_prefix"""

PRODUCTS_FILLED = """
WITH p AS (
  SELECT product_id,
         coalesce(product_category_name, 'Uncategorized') AS product_category_name,
         cast(coalesce(product_name_lenght, 0) AS double) AS product_name_lenght,
         cast(coalesce(product_description_lenght, 0) AS double) AS product_description_lenght,
         cast(coalesce(product_photos_qty, 0) AS double) AS product_photos_qty,
         cast(product_weight_g AS double) AS product_weight_g,
         cast(product_length_cm AS double) AS product_length_cm,
         cast(product_height_cm AS double) AS product_height_cm,
         cast(product_width_cm AS double) AS product_width_cm
  FROM fx_products_raw
), m AS (
  SELECT product_category_name, median(product_weight_g) AS mw, median(product_length_cm) AS ml,
         median(product_height_cm) AS mh, median(product_width_cm) AS mwi
  FROM p GROUP BY product_category_name
)
SELECT p.product_id, p.product_category_name, p.product_name_lenght, p.product_description_lenght,
       p.product_photos_qty,
       coalesce(p.product_weight_g, m.mw) AS product_weight_g,
       coalesce(p.product_length_cm, m.ml) AS product_length_cm,
       coalesce(p.product_height_cm, m.mh) AS product_height_cm,
       coalesce(p.product_width_cm, m.mwi) AS product_width_cm
FROM p JOIN m ON p.product_category_name = m.product_category_name"""


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _shapes() -> str:
    return _union([f"SELECT '{n}' AS table_name, count(*) AS n_rows, cast({len(c)} AS bigint) AS n_cols FROM {v}"
                   for n, v, c in RAW])


def _info() -> str:
    return _union([
        f"SELECT '{c}' AS column_name, cast({i} AS bigint) AS ordinal, count({c}) AS non_null_count, '{ty}' AS dtype FROM fx_orders"
        for i, (c, ty) in enumerate(zip(COLS["orders"], ORDER_TYPES))
    ])


def _per_column(expr: str, value: str) -> str:
    return _union([
        f"SELECT '{c}' AS column_name, cast({i} AS bigint) AS ordinal, cast({expr.format(c=c)} AS bigint) AS {value} FROM fx_products_raw"
        for i, c in enumerate(COLS["products"])
    ])


def _dups(view: str, keys: list[str], name: str) -> str:
    k = ", ".join(keys)
    return (f"SELECT '{name}' AS table_name, cast(coalesce(sum(cnt - 1), 0) AS bigint) AS duplicate_rows "
            f"FROM (SELECT count(*) AS cnt FROM {view} GROUP BY {k}) g")


def _describe(view: str, table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"cast({c} AS double)"
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c}) AS count, "
            f"{RD(f'cast(sum({c}) AS double) / cast(nullif(count({c}), 0) AS double)', 6)} AS mean, "
            f"{RD(f'stddev_samp({x})', 6)} AS std, cast(min({c}) AS double) AS min, "
            f"{RD(f'quantile_cont({x}, 0.25)', 6)} AS p25, {RD(f'quantile_cont({x}, 0.5)', 6)} AS p50, "
            f"{RD(f'quantile_cont({x}, 0.75)', 6)} AS p75, cast(max({c}) AS double) AS max FROM {view}"
        )
    return _union(parts)


def _corr(view: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, "
                         f"{RD(f'corr(cast({a} AS double), cast({b} AS double))', 8)} AS corr FROM {view}")
    return _union(parts)


HISTOGRAM = """
WITH x AS (SELECT cast(price AS double) AS x FROM fx_order_items WHERE price IS NOT NULL),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM x),
c AS (
  SELECT cast(least(floor((x.x - b.lo) / nullif((b.hi - b.lo) / cast(10 AS double), 0)), 9) AS bigint) AS bin,
         count(*) AS cnt
  FROM x CROSS JOIN b GROUP BY 1
),
bins AS (SELECT range AS bin FROM range(10))
SELECT bins.bin,
       b.lo + bins.bin * ((b.hi - b.lo) / cast(10 AS double)) AS lower,
       CASE WHEN bins.bin = 9 THEN b.hi ELSE b.lo + (bins.bin + 1) * ((b.hi - b.lo) / cast(10 AS double)) END AS upper,
       coalesce(c.cnt, 0) AS "count"
FROM bins CROSS JOIN b LEFT JOIN c ON c.bin = bins.bin"""

TIMELINE = f"""
SELECT order_id, order_status, a AS approved_before_purchase, b AS carrier_before_approval, c AS delivered_before_carrier
FROM (
  SELECT order_id, order_status,
         coalesce(order_approved_at < order_purchase_timestamp, false) AS a,
         coalesce(order_delivered_carrier_date < order_approved_at, false) AS b,
         coalesce(order_delivered_customer_date < order_delivered_carrier_date, false) AS c
  FROM fx_orders
) t WHERE a OR b OR c"""

NULL_POLICY = _union([
    f"""SELECT '{c}' AS column_name, order_status,
       count(*) FILTER (WHERE {c} IS NOT NULL) AS present,
       count(*) FILTER (WHERE {c} IS NULL AND NOT coalesce(order_status IN ({req}), false)) AS expected_null,
       count(*) FILTER (WHERE {c} IS NULL AND coalesce(order_status IN ({req}), false)) AS invalid_null
FROM fx_orders GROUP BY order_status"""
    for c, req in [("order_approved_at", "'delivered'"), ("order_delivered_carrier_date", "'shipped', 'delivered'"),
                   ("order_delivered_customer_date", "'delivered'")]
])

QUALITY = {
    "p01_source_shapes": _shapes(),
    "p03_orders_info": _info(),
    "p04_products_nulls": _per_column("count(*) - count({c})", "null_count"),
    "p06_products_nunique": _per_column("count(DISTINCT {c})", "n_unique"),
    "p07_payment_types": "SELECT DISTINCT payment_type FROM fx_order_payments",
    "p08_source_duplicates": _union([_dups(v, c, n) for n, v, c in RAW]),
    "p09_key_duplicates": _union([
        _dups("fx_geolocation", GEO_KEY, "geolocation"),
        _dups(f"({GEO_CENTROIDS}) gc", GEO_KEY, "geoloc_clean"),
        _dups("fx_order_payments", ["order_id"], "order_payments"),
    ]),
    "p10_status_counts": 'SELECT order_status, count(*) AS "count" FROM fx_orders '
                         "WHERE order_status IS NOT NULL GROUP BY order_status",
    "p11_null_status": _union([
        f"SELECT '{c}' AS column_name, order_status, count(*) AS \"count\" FROM fx_orders "
        f"WHERE {c} IS NULL AND order_status IS NOT NULL GROUP BY order_status"
        for c in ORDER_DATES
    ]),
    "p12_describe": _union([_describe("fx_order_items", "order_items", ["price"]),
                            _describe("fx_products_raw", "products", PRODUCT_NUMERIC)]),
    "p13_price_freight_corr": _corr("fx_order_items", ["price", "freight_value"]),
    "p14_products_corr": _corr("fx_products_raw", PRODUCT_NUMERIC),
    "p15_price_histogram": HISTOGRAM,
    "p16_orders_head": f"""
SELECT order_id, customer_id, order_status, {TS("order_purchase_timestamp")} AS order_purchase_timestamp,
       {TS("order_approved_at")} AS order_approved_at, {TS("order_delivered_carrier_date")} AS order_delivered_carrier_date,
       {TS("order_delivered_customer_date")} AS order_delivered_customer_date,
       {TS("order_estimated_delivery_date")} AS order_estimated_delivery_date
FROM fx_orders ORDER BY order_id LIMIT 5""",
    "p17_orders_sample": f"""
SELECT order_id, customer_id, order_status, {TS("order_purchase_timestamp")} AS order_purchase_timestamp,
       {TS("order_approved_at")} AS order_approved_at, {TS("order_delivered_carrier_date")} AS order_delivered_carrier_date,
       {TS("order_delivered_customer_date")} AS order_delivered_customer_date,
       {TS("order_estimated_delivery_date")} AS order_estimated_delivery_date
FROM fx_orders ORDER BY md5(concat('42:', order_id)), order_id LIMIT 5""",
    "p18_timeline_errors": TIMELINE,
    "c02_geo_dedup": """
SELECT cast(geolocation_zip_code_prefix AS bigint) AS geolocation_zip_code_prefix, geolocation_lat, geolocation_lng,
       geolocation_city
FROM (SELECT DISTINCT * FROM fx_geolocation) d""",
    "c03_payments_keep_first": """
SELECT order_id, payment_type, cast(payment_installments AS bigint) AS payment_installments,
       cast(payment_value AS double) AS payment_value
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY payment_type ASC NULLS FIRST,
                                   payment_installments ASC NULLS FIRST, payment_value ASC NULLS FIRST) AS rn
      FROM fx_order_payments) x
WHERE rn = 1""",
    "c04_geo_centroids": f"""
SELECT cast(geolocation_zip_code_prefix AS bigint) AS geolocation_zip_code_prefix, geolocation_lat, geolocation_lng
FROM ({GEO_CENTROIDS}) g""",
    "c05_items_lenient_ts": f"""
SELECT order_id, cast(order_item_id AS bigint) AS order_item_id,
       {TS("try_cast(shipping_limit_date AS timestamp)")} AS shipping_limit_date
FROM fx_order_items""",
    "c06_reviews_filled": """
SELECT order_id, cast(review_score AS double) AS review_score,
       coalesce(review_comment_message, 'NO COMMENT') AS review_comment_message
FROM fx_order_reviews""",
    "c09_products_filled": PRODUCTS_FILLED,
    "c10_12_orders_dq_flags": """
SELECT order_id, order_status,
       coalesce(order_status = 'delivered' AND order_approved_at IS NULL, false) AS dq_invalid_approval_null,
       coalesce(order_status IN ('shipped', 'delivered') AND order_delivered_carrier_date IS NULL, false)
         AS dq_invalid_carrier_null,
       coalesce(order_status = 'delivered' AND order_delivered_customer_date IS NULL, false) AS dq_invalid_delivery_null
FROM fx_orders""",
    "c13_orders_null_policy": NULL_POLICY,
    "c18_dim_products": f"""
WITH f AS ({PRODUCTS_FILLED})
SELECT f.product_id, coalesce(c.product_category_name_english, 'Unknown') AS category_name,
       f.product_weight_g AS weight_g, f.product_length_cm AS length_cm, f.product_height_cm AS height_cm,
       f.product_width_cm AS width_cm, f.product_photos_qty AS photos_qty
FROM f LEFT JOIN fx_categories c ON f.product_category_name = c.product_category_name""",
    "s13_revenue_trend_projection": f"""
SELECT month_start, total_orders, gross_revenue, aov, mom_growth_pct, yoy_growth_pct, ytd_revenue
FROM ({V01}) v""",
}
