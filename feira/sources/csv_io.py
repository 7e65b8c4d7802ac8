"""CSV sources (S-01..S-09), the prepared-table sink (S-10) and the preparation pipeline.

Columns are bound by the file's header: a declared column gets its declared
type wherever it stands, an undeclared one is kept as text (whole-row
operations such as duplicate counts see it), a missing one is an error, and so
is a file whose header differs from the first one's. No type is inferred.
Review texts may hold quotes, commas and newlines: pandas writes them quoted with
doubled quotes, so that table is read by ``sources.split_csv``, whose tasks each read a part of a file; the other
tables have no line breaks in their fields and are read by Spark's own splittable reader.
The prepared output is written as Parquet (columnar) by default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, DataFrameReader, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feira.operators import prepare
from feira.sources.bridge import Tables
from feira.sources.split_csv import read_split_csv
from feira.sources.schemas import PREPARED, RAW, RAW_FILES, RAW_TIMESTAMPS

# Fixed value: the text form of timestamps in the source and prepared CSV files.
CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"

# Prepared table name -> Tables attribute holding it.
PREPARED_TABLES = {
    "customers": "customers",
    "geoloc": "geoloc",
    "order_items": "order_items",
    "order_payments": "order_payments",
    "order_reviews": "order_reviews",
    "orders": "orders",
    "products": "products",
    "sellers": "sellers",
    "categories": "categories",
}


MULTI_LINE = "order_reviews"  # the one table with line breaks inside its fields
# A compressed CSV file is read by one task, so it holds at most this many rows.
ROWS_PER_COMPRESSED_FILE = 250_000

# The sources' folder, or each source's own folder by its table name.
Sources = str | Mapping[str, str]


def folder_of(src: Sources, name: str) -> str:
    return src if isinstance(src, str) else src[name]


def _read_by_header(spark: SparkSession, path: str | list[str], declared: T.StructType, multi_line: bool) -> DataFrame:
    """A CSV file (or folder of files) with its columns bound by name; see the module docstring."""

    def reader() -> DataFrameReader:
        r = spark.read.option("header", True).option("quote", '"').option("escape", '"')
        return r.option("timestampNTZFormat", CSV_TIMESTAMP)

    header = reader().csv(path).columns  # reads the header line only
    types = {f.name: f.dataType for f in declared.fields}
    missing = [c for c in types if c not in header]
    if missing:
        raise ValueError(f"{path}: the header lacks the columns {missing}; it has {header}")
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType()), True) for c in header])
    if multi_line:
        return read_split_csv(spark, path, schema, {"timestampNTZFormat": CSV_TIMESTAMP})
    # enforceSchema=False makes Spark compare every file's header with these names
    return reader().schema(schema).option("enforceSchema", False).csv(path)


def read_raw_csv(spark: SparkSession, src_dir: str, name: str) -> DataFrame:
    """S-01..S-09: one raw source file (or directory of files), all its columns, typed as declared."""
    return _read_by_header(spark, f"{src_dir.rstrip('/')}/{RAW_FILES[name]}", RAW[name], name == MULTI_LINE)


def read_csv_files(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """The given files of one source without line breaks in its fields, typed as declared."""
    return _read_by_header(spark, paths, RAW[name], False)


# Raw table name -> Tables attribute holding the (bridged) raw frame.
RAW_TABLES = {
    "customers": "customers",
    "geoloc": "geolocation_raw",
    "order_items": "order_items_raw",
    "order_payments": "order_payments",
    "order_reviews": "order_reviews_raw",
    "orders": "orders_raw",
    "products": "products_raw",
    "sellers": "sellers",
    "categories": "categories",
}


def raw_tables(spark: SparkSession, src: Sources, names: Iterable[str] = tuple(RAW_TABLES)) -> Tables:
    """The raw sources as a ``Tables`` (raw names: orders_raw, order_items_raw, ...), all nine unless ``names`` says which."""
    return Tables(**{RAW_TABLES[name]: read_raw_csv(spark, folder_of(src, name), name) for name in names})


def _csv_writer(df: DataFrame, name: str, compression: str | None) -> DataFrameWriter:
    """A CSV writer; the table with line breaks inside its fields stays plain, so that its files can be split."""
    writer = (
        df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
        .option("timestampNTZFormat", CSV_TIMESTAMP)
    )
    if compression and name != MULTI_LINE:
        writer = writer.option("compression", compression).option("maxRecordsPerFile", ROWS_PER_COMPRESSED_FILE)
    return writer


def export_raw_csv(t: Tables, out_dir: str, names: Iterable[str] = tuple(RAW_TABLES), compression: str | None = None) -> None:
    """Write raw tables as source CSV files (one directory each, header, source column order), all nine unless ``names`` says which.

    Columns missing from a frame are written empty; timestamps use the
    sources' ``yyyy-MM-dd HH:mm:ss`` text form.
    """
    for name in names:
        df = getattr(t, RAW_TABLES[name])
        declared = [f.name for f in RAW[name].fields]
        cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in declared]
        cols += [F.col(c) for c in df.columns if c not in declared]
        _csv_writer(df.select(*cols), name, compression).csv(f"{out_dir.rstrip('/')}/{RAW_FILES[name]}")


def _prepared_reviews(raw: Tables) -> DataFrame:
    reviews = prepare.fill_comment(prepare.drop_columns(raw.order_reviews_raw, ["review_comment_title"]))
    return prepare.parse_timestamps(reviews, RAW_TIMESTAMPS["order_reviews"])


# The notebook's preparation of every table (cells between load and export).
PREPARATION: dict[str, Callable[[Tables], DataFrame]] = {
    "customers": lambda raw: raw.customers,
    "geoloc": lambda raw: prepare.geo_centroids(raw.geolocation_raw),
    "order_items": lambda raw: prepare.parse_timestamps(raw.order_items_raw, RAW_TIMESTAMPS["order_items"]),
    "order_payments": lambda raw: raw.order_payments,
    "order_reviews": _prepared_reviews,
    "orders": lambda raw: prepare.add_dq_flags(prepare.parse_timestamps(raw.orders_raw, RAW_TIMESTAMPS["orders"])),
    "products": lambda raw: prepare.dim_products(raw.products_raw, raw.categories),
    "sellers": lambda raw: raw.sellers,
    "categories": lambda raw: raw.categories,
}


def sources_of(name: str) -> list[str]:
    """The raw sources that a prepared table is made of."""
    return ["products", "categories"] if name == "products" else [name]


def prepare_tables(raw: Tables, names: Iterable[str] = tuple(PREPARED_TABLES)) -> Tables:
    """The prepared tables, all nine unless ``names`` says which."""
    return Tables(**{PREPARED_TABLES[name]: PREPARATION[name](raw) for name in names})


def write_prepared(
    t: Tables, out_dir: str, fmt: str = "parquet", names: Iterable[str] = tuple(PREPARED_TABLES), compression: str | None = None
) -> None:
    """S-10: write prepared tables (``fmt`` 'parquet' or 'csv' with header; NULL as empty), all nine unless ``names`` says which.

    CSV booleans are written ``true``/``false`` (Spark's form; pandas writes ``True``/``False``).
    """
    for name in names:
        df = getattr(t, PREPARED_TABLES[name])
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            _csv_writer(df, name, compression).csv(path)
        else:
            df.write.mode("overwrite").parquet(path)


def read_prepared(spark: SparkSession, src_dir: str, fmt: str = "parquet", names: Iterable[str] = tuple(PREPARED_TABLES)) -> Tables:
    """Prepared tables written by ``write_prepared``, with their declared schemas, all nine unless ``names`` says which."""
    frames = {}
    for name in names:
        path = f"{src_dir.rstrip('/')}/{name}"
        df = _read_by_header(spark, path, PREPARED[name], name == MULTI_LINE) if fmt == "csv" else spark.read.parquet(path)
        frames[PREPARED_TABLES[name]] = df.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in PREPARED[name].fields})
    return Tables(**frames)
