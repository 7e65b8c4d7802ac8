"""Cleaning and preparation (the notebook's mutating cells), as DataFrame transforms.

Each pandas in-place mutation becomes a pure function ``DataFrame -> DataFrame``.
Nothing here collects data: grouped statistics (medians, centroids) are
aggregated per key and joined back on that key.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from feira.functions.dates import lenient_timestamp

# Fixed values that must equal the reference's: fill texts, the physical
# columns filled by category median, and the status rules of the DQ flags.
NO_COMMENT = "NO COMMENT"
UNCATEGORIZED = "Uncategorized"
UNKNOWN_CATEGORY = "Unknown"
ZERO_FILLED = ["product_photos_qty", "product_name_lenght", "product_description_lenght"]
PHYSICAL = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
DIM_PRODUCT_RENAMES = {
    "product_category_name_english": "category_name",
    "product_weight_g": "weight_g",
    "product_length_cm": "length_cm",
    "product_height_cm": "height_cm",
    "product_width_cm": "width_cm",
    "product_photos_qty": "photos_qty",
}
# (flag column, statuses that require the date, date column)
DQ_RULES = [
    ("dq_invalid_approval_null", ["delivered"], "order_approved_at"),
    ("dq_invalid_carrier_null", ["shipped", "delivered"], "order_delivered_carrier_date"),
    ("dq_invalid_delivery_null", ["delivered"], "order_delivered_customer_date"),
]


# --- C-01 / C-02 / C-03: drops and de-duplication ------------------------------------------

def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """C-01 ``drop(columns=...)``."""
    return df.drop(*cols)


def dedup_rows(df: DataFrame) -> DataFrame:
    """C-02 ``drop_duplicates()`` over all columns (NULLs compare equal, as in pandas)."""
    return df.distinct()


def dedup_keep_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C-03 ``drop_duplicates(subset=keys)`` with a deterministic "first" row.

    Spark has no file order, so "first" is the row with the smallest values of
    the remaining columns, compared left to right with NULLs first. One struct minimum per key:
    the input is evaluated once, and a key holding a third of all rows is reduced inside the map tasks.
    """
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    first = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_first"))
    return first.select(*[F.col(f"`{k}`") for k in keys], *[F.col("_first").getField(c).alias(c) for c in others])


# --- C-04: centroid per zip prefix ----------------------------------------------------------

def geo_centroids(geoloc: DataFrame) -> DataFrame:
    """C-02 + C-04: de-duplicate rows, then mean lat/lng per zip prefix.

    pandas ``groupby`` drops NULL keys, so rows without a zip prefix are dropped.
    """
    return (
        dedup_rows(geoloc)
        .filter(F.col("geolocation_zip_code_prefix").isNotNull())
        .groupBy("geolocation_zip_code_prefix")
        .agg(F.avg("geolocation_lat").alias("geolocation_lat"), F.avg("geolocation_lng").alias("geolocation_lng"))
    )


# --- C-05 .. C-08: parsing and fills --------------------------------------------------------

def parse_timestamps(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """C-05 ``to_datetime(errors='coerce')`` on each column."""
    return df.withColumns({c: lenient_timestamp(c) for c in cols})


def fill_comment(reviews: DataFrame) -> DataFrame:
    """C-06 review text default."""
    return reviews.fillna({"review_comment_message": NO_COMMENT})


def fill_product_metadata(products: DataFrame) -> DataFrame:
    """C-07 category default and C-08 zero fills."""
    return products.fillna({"product_category_name": UNCATEGORIZED}).fillna(0.0, subset=ZERO_FILLED)


def fill_median_by_group(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """C-09 ``groupby(group)[c].transform(lambda x: x.fillna(x.median()))``.

    The medians (one row per group) are joined back and used in ``coalesce``. A group whose values are all NULL keeps NULL, as in pandas.
    """
    medians = group_medians(df, group, cols)
    return (
        df.join(medians, F.col(group) == F.col("_g"), how="left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in cols})
        .drop("_g", *[f"_median_{c}" for c in cols])
    )


def group_medians(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """(_g, _median_<column>, ..): the exact interpolated median of each column's non-NULL values in each group.

    All columns are counted in one pass, per (group, column, value) with partial aggregation, and one window's running count
    picks the middle one or two values of each (group, column): no buffer holds a group, and the window
    sorts (with spilling) one row per distinct value.
    """
    cells = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))) for i, c in enumerate(cols)]
    packed = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.explode(F.array_compact(F.array(*cells))).alias("x"))
    values = packed.select("_g", "x.c", "x.v").groupBy("_g", "c", "v").count()
    part = W.partitionBy("_g", "c")
    upto = F.sum("count").over(part.orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = values.withColumn("upto", upto).withColumn("n", F.sum("count").over(part))
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)  # positions from 1 of the middle rows
    holds = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("count") < at)
    middle = ranked.filter(holds(low) | holds(high))
    of = lambda i: F.when(F.col("c") == i, F.col("v"))
    return middle.groupBy("_g").agg(*[((F.min(of(i)) + F.max(of(i))) / 2.0).alias(f"_median_{c}") for i, c in enumerate(cols)])


def fill_products(products_raw: DataFrame) -> DataFrame:
    """C-07, C-08, C-09 in the notebook's order (the median groups include 'Uncategorized')."""
    return fill_median_by_group(fill_product_metadata(products_raw), "product_category_name", PHYSICAL)


# --- C-10 .. C-13: status-aware data-quality flags -----------------------------------------

def dq_flag(status: Column, required_for: Sequence[str], date: Column) -> Column:
    """True when the status requires the date and it is missing; never NULL (pandas gives False)."""
    return F.coalesce(status.isin(*required_for) & date.isNull(), F.lit(False))


def add_dq_flags(orders: DataFrame) -> DataFrame:
    """C-10, C-11, C-12."""
    status = F.col("order_status")
    return orders.withColumns({flag: dq_flag(status, req, F.col(c)) for flag, req, c in DQ_RULES})


def null_policy_report(orders: DataFrame) -> DataFrame:
    """C-13: per (date column, status), how many values are present, expected NULLs, invalid NULLs.

    One pass: the three date columns are unpivoted, then counted per group.
    """
    status = F.col("order_status")
    stacked = orders.select(
        status,
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column_name"),
                        F.col(c).isNull().alias("is_null"),
                        dq_flag(status, req, F.col(c)).alias("is_invalid"),
                    )
                    for _, req, c in DQ_RULES
                ]
            )
        ).alias("s"),
    )
    is_null, invalid = F.col("s.is_null"), F.col("s.is_invalid")
    return stacked.groupBy(F.col("s.column_name").alias("column_name"), status).agg(
        F.count_if(~is_null).alias("present"),
        F.count_if(is_null & ~invalid).alias("expected_null"),
        F.count_if(invalid).alias("invalid_null"),
    )


# --- C-14 .. C-18: product dimension --------------------------------------------------------

def dim_products(products_raw: DataFrame, categories: DataFrame) -> DataFrame:
    """C-18 = fills (C-07..09) -> left join translation (C-14) -> select (C-15) -> rename (C-16)
    -> de-duplicate on product_id (C-03) -> 'Unknown' category (C-17).

    The translation table is joined without a hint; its size is known at plan
    time (a small file) or at run time (AQE), and Spark broadcasts it only when
    below the broadcast threshold.
    """
    filled = fill_products(products_raw)
    joined = filled.join(categories, on="product_category_name", how="left")
    selected = joined.select(
        "product_id",
        *[F.col(src).alias(dst) for src, dst in DIM_PRODUCT_RENAMES.items()],
    )
    return dedup_keep_first(selected, ["product_id"]).fillna({"category_name": UNKNOWN_CATEGORY})
