"""Reference-shaped tables derived from the driver's TPC-H-like parquet tables.

The reference's nine CSV files are not available, so each of its tables is
derived deterministically from ``orders``, ``lineitem``, ``customer``,
``nation``, ``region``, ``part`` and ``supplier`` (the rules are written out in
FIXTURES.md and mirrored as SQL in ``duck_oracle.fixtures``). Everything here
is lazy: each table is a projection/filter over a parquet scan, so Catalyst
prunes unused columns and pushes the status filter of every view into the
derivation.

Ids are BIGINT here (the real source uses strings); nothing downstream
depends on the id type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The prepared tables the views read, built lazily from ``sf_dir`` on first access.

    Frames can also be given directly (``Tables(orders=df, ...)``), e.g. small
    hand-made frames in tests; a table that is neither given nor derivable
    raises ``KeyError``.
    """

    NAMES = (
        "orders", "order_items", "order_payments", "order_reviews", "customers",
        "products", "sellers", "categories", "geoloc", "products_raw", "geolocation_raw", "order_items_raw",
        "orders_raw", "order_reviews_raw",
    )

    def __init__(self, spark: SparkSession | None = None, sf_dir: str | None = None, **frames: DataFrame):
        unknown = set(frames) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._spark, self._sf_dir, self._frames = spark, sf_dir, dict(frames)
        self._shared: dict[str, DataFrame] = {}

    def _get(self, name: str) -> DataFrame:
        if name not in self._frames:
            if self._spark is None:
                raise KeyError(f"table {name!r} was not provided")
            self._frames[name] = getattr(self, f"_build_{name}")()
        return self._frames[name]

    def shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived frame that several views of these tables use, built once."""
        if name not in self._shared:
            self._shared[name] = build()
        return self._shared[name]

    # -- derivations (the notebook's preparation applied to the bridged raw tables) --
    def _build_orders_raw(self) -> DataFrame:
        return bridge_orders(self._spark, self._sf_dir)

    def _build_orders(self) -> DataFrame:
        from feira.operators import prepare

        return prepare.add_dq_flags(self.orders_raw)

    def _build_order_items_raw(self) -> DataFrame:
        return bridge_order_items_raw(self._spark, self._sf_dir)

    def _build_order_items(self) -> DataFrame:
        from feira.operators import prepare

        return prepare.parse_timestamps(self.order_items_raw, ["shipping_limit_date"])

    def _build_order_payments(self) -> DataFrame:
        return bridge_order_payments(self._spark, self._sf_dir)

    def _build_order_reviews_raw(self) -> DataFrame:
        return bridge_order_reviews(self._spark, self._sf_dir)

    def _build_order_reviews(self) -> DataFrame:
        from feira.operators import prepare

        return prepare.fill_comment(self.order_reviews_raw)

    def _build_customers(self) -> DataFrame:
        return bridge_customers(self._spark, self._sf_dir)

    def _build_products_raw(self) -> DataFrame:
        return bridge_products_raw(self._spark, self._sf_dir)

    def _build_categories(self) -> DataFrame:
        return bridge_categories(self._spark, self._sf_dir)

    def _build_products(self) -> DataFrame:
        from feira.operators import prepare

        return prepare.dim_products(self.products_raw, self.categories)

    def _build_sellers(self) -> DataFrame:
        return bridge_sellers(self._spark, self._sf_dir)

    def _build_geolocation_raw(self) -> DataFrame:
        return bridge_geolocation(self._spark, self._sf_dir)

    def _build_geoloc(self) -> DataFrame:
        from feira.operators import prepare

        return prepare.geo_centroids(self.geolocation_raw)

    orders = property(lambda self: self._get("orders"))
    orders_raw = property(lambda self: self._get("orders_raw"))
    order_reviews_raw = property(lambda self: self._get("order_reviews_raw"))
    order_items = property(lambda self: self._get("order_items"))
    order_items_raw = property(lambda self: self._get("order_items_raw"))
    order_payments = property(lambda self: self._get("order_payments"))
    order_reviews = property(lambda self: self._get("order_reviews"))
    customers = property(lambda self: self._get("customers"))
    products = property(lambda self: self._get("products"))
    products_raw = property(lambda self: self._get("products_raw"))
    sellers = property(lambda self: self._get("sellers"))
    categories = property(lambda self: self._get("categories"))
    geoloc = property(lambda self: self._get("geoloc"))
    geolocation_raw = property(lambda self: self._get("geolocation_raw"))


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours(n: Column, ts: Column) -> Column:
    return F.timestamp_add("HOUR", n, ts)


def _days(n: Column, ts: Column) -> Column:
    return F.timestamp_add("DAY", n, ts)


def _cents_to_money(cents: Column) -> Column:
    return (cents.cast("decimal(12,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(12,2)")


def customer_of(order_key: Column) -> Column:
    """The per-order customer id: its own numbering, never equal to an order id of the data."""
    return -order_key * 2 - 1


def bridge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = read_source(spark, sf_dir, "orders").select(
        k,
        F.col("o_orderdate"),
        F.when(k % 50 == 0, "canceled")
        .when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "shipped")
        .when(k % 29 == 0, "processing")
        .otherwise("delivered")
        .alias("order_status"),
        _hours(k % 24, F.col("o_orderdate")).alias("purchase"),
    )
    p, status = F.col("purchase"), F.col("order_status")
    return base.select(
        k.alias("order_id"),
        customer_of(k).alias("customer_id"),
        status,
        p.alias("order_purchase_timestamp"),
        F.when(k % 97 == 0, F.lit(None))
        .when(k % 43 == 0, _hours(F.lit(-1), p))
        .otherwise(_hours(k % 24, p))
        .alias("order_approved_at"),
        F.when((k % 53 == 0) | (status == "processing"), F.lit(None))
        .when(k % 41 == 0, _days(F.lit(-1), p))
        .otherwise(_days(1 + k % 4, p))
        .alias("order_delivered_carrier_date"),
        F.when((k % 37 == 0) | (status != "delivered"), F.lit(None))
        .when(k % 59 == 0, _hours(F.lit(2), p))
        .otherwise(_days(5 + k % 26, p))
        .alias("order_delivered_customer_date"),
        _days(F.lit(18), F.col("o_orderdate")).alias("order_estimated_delivery_date"),
    )


def bridge_order_items_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order items with ``shipping_limit_date`` still as text (some of it unparseable)."""
    li = read_source(spark, sf_dir, "lineitem")
    ok, pk, ln, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")
    return li.select(
        ok.alias("order_id"),
        ln.alias("order_item_id"),
        pk.alias("product_id"),
        # sellers 10, 20, .. sell only in orders without a review
        F.when((sk % 10 == 0) & (ok % 11 != 0), sk - 1).otherwise(sk).alias("seller_id"),
        _cents_to_money(F.col("l_quantity") * 1250 + F.when(ok % 3 == 0, pk % 100).otherwise(0)).alias("price"),
        _cents_to_money(500 + ln * 125 + pk % 50).alias("freight_value"),
        F.when((ln == 7) & (pk % 5 == 0), F.lit("not-a-date"))
        .otherwise(F.col("l_shipdate").cast("string"))
        .alias("shipping_limit_date"),
    )


def bridge_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_source(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    card = k % 10 < 7
    main = o.select(
        k.alias("order_id"),
        F.when(card, "credit_card").when(k % 10 < 9, "boleto").otherwise("debit_card").alias("payment_type"),
        F.when(card, k % 13).otherwise(1).cast("int").alias("payment_installments"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"),
    )
    voucher = o.filter(k % 10 == 3).select(
        k.alias("order_id"),
        F.lit("voucher").alias("payment_type"),
        F.lit(1).cast("int").alias("payment_installments"),
        F.lit(10.50).cast("decimal(12,2)").alias("payment_value"),
    )
    return main.unionByName(voucher)


def bridge_order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_source(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    first = o.filter(k % 11 != 0).select(
        k.alias("order_id"),
        F.when(k % 101 != 0, 1 + (k * 3) % 5).cast("int").alias("review_score"),
        F.when(k % 2 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority"))
        .alias("review_comment_message"),
        F.col("o_orderdate").alias("review_creation_date"),
    )
    second = o.filter((k % 13 == 0) & (k % 11 != 0)).select(
        k.alias("order_id"),
        (1 + k % 4).cast("int").alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col("o_orderdate").alias("review_creation_date"),
    )
    return first.unionByName(second)


def bridge_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = read_source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    return (
        o.join(c, ck == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            customer_of(k).alias("customer_id"),
            F.when(k % 4 != 0, F.lit(100000000) + k)
            .when(ck % 2 == 1, ck)
            .otherwise(ck - ck % 6)
            .alias("customer_unique_id"),
            F.col("c_mktsegment").alias("customer_city"),
            F.col("n_name").alias("customer_state"),
        )
    )


def bridge_products_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_source(spark, sf_dir, "part")
    pk, size = F.col("p_partkey"), F.col("p_size")

    def unless(cond: Column, value: Column) -> Column:
        return F.when(cond, F.lit(None)).otherwise(value).cast("double")

    return p.select(
        pk.alias("product_id"),
        F.when(pk % 40 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("product_category_name"),
        unless(pk % 17 == 0, F.length("p_name")).alias("product_name_lenght"),
        unless(pk % 17 == 0, F.length("p_name") * 10).alias("product_description_lenght"),
        unless(pk % 23 == 0, size % 7).alias("product_photos_qty"),
        unless(pk % 19 == 0, size * 100).alias("product_weight_g"),
        unless(pk % 31 == 0, size + 10).alias("product_length_cm"),
        unless(pk % 31 == 0, size + 3).alias("product_height_cm"),
        unless((pk % 31 == 0) | (F.col("p_brand") == "Brand#9"), size + 5).alias("product_width_cm"),
    )


def bridge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read_source(spark, sf_dir, "part")
        .filter(F.col("p_brand") != "Brand#7")
        .select(
            F.col("p_brand").alias("product_category_name"),
            F.concat(F.lit("cat_"), F.lower("p_brand")).alias("product_category_name_english"),
        )
        .distinct()
    )


def bridge_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_source(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = read_source(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_source(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("n_name").alias("seller_city"),
            F.col("r_name").alias("seller_state"),
        )
    )


def bridge_geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_source(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    ck = F.col("c_custkey")

    def rows(df: DataFrame) -> DataFrame:
        return df.select(
            (ck % 100).cast("int").alias("geolocation_zip_code_prefix"),
            ((ck * 37) % 1000).cast("int") / F.lit(8.0),
            ((ck * 53) % 1000).cast("int") / F.lit(8.0),
            F.col("c_mktsegment").alias("geolocation_city"),
        ).toDF("geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng", "geolocation_city")

    return rows(c).unionByName(rows(c.filter(ck % 10 == 0)))


def load_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All reference-shaped tables over ``sf_dir`` (lazy: each is built on first use)."""
    return Tables(spark, sf_dir)
