"""Incremental refresh: partial aggregates kept per source file, merged when a view is read (S-10 -> S-11).

The reference prepares all of its files again whenever one of them changes. Here the rows of every source file are prepared and
aggregated once; what is stored is the file's partial aggregate, whose sums merge with those of other files. A refresh

1. lists the files (path, length, change time; no content is read) and compares the list with the stored one;
2. reads the new and the changed files only, in one Spark job whatever their number, and writes their partials as one batch;
3. writes the batch's list of files last. Rows count only if the list of their batch names their file, so a batch that was ended early,
   or a file that was replaced while it was read, leaves nothing that is ever used.

``merged`` takes the batches of the files that exist now (a deleted or replaced file's partials drop out) and adds the
partials up, which equals aggregating all files at once: sums are exact decimals and integers. Two refreshes at
the same time store a file twice; the later batch counts. ``compact`` rewrites the partials in use as one batch, without reading a source.

The driver holds the names of the files to be read, as it does in any scan, and nothing of their rows. A key
with a third of the rows is one row per file and map task before any shuffle.

Defined cases: a file without rows is listed and not read again; null keys are a group; a sum of no values is null; a source
folder without files that was never read is an error, and one whose files are all gone is an empty result.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.operators import prepare
from feira.session import ensure_checkpoint_dir
from feira.sources.bridge import Tables
from feira.sources.csv_io import Sources, folder_of, read_csv_files
from feira.sources.schemas import RAW_FILES, RAW_TIMESTAMPS

FILE, BATCH = "__source_file", "__batch"


@dataclass(frozen=True)
class Partials:
    """What is kept of every file of one source: sums by ``keys``, or the prepared rows themselves where there are no sums."""

    name: str
    read: Callable[[SparkSession, list[str]], DataFrame]
    keys: list[str]
    sums: Mapping[str, str] = field(default_factory=dict)  # name -> SQL expression over a row
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df  # row by row

    def of_files(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        rows = self.prepare(self.read(spark, paths).withColumn(FILE, _state()))
        if not self.sums:
            return rows.select(FILE, *self.keys)
        return rows.groupBy(FILE, *self.keys).agg(*[F.sum(F.expr(x)).alias(n) for n, x in self.sums.items()])

    def merge(self, partial: DataFrame) -> DataFrame:
        if not self.sums:
            return partial.select(*self.keys)
        return partial.groupBy(*self.keys).agg(*[F.sum(n).alias(n) for n in self.sums])


def _state() -> Column:
    """A name for a file as it is now, from the scan's own metadata."""
    m = [F.col(f"_metadata.{c}").cast("string") for c in ("file_path", "file_size", "file_modification_time")]
    return F.sha1(F.concat_ws("\n", *m))


def _listing(spark: SparkSession, source: str) -> DataFrame:
    """(file state, path) of the files at ``source``; only their names and states are read."""
    return spark.read.format("binaryFile").load(source).select(_state().alias(FILE), "path")


def _store(spark: SparkSession, part: Partials, source: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/feira-increments/{part.name}-{hashlib.sha1(source.encode()).hexdigest()[:16]}"


def _listed(spark: SparkSession, store: str) -> DataFrame | None:
    """(file state, batch): for every file that was stored the latest batch that holds it."""
    try:
        files = spark.read.parquet(f"{store}/files")
    except AnalysisException:  # nothing was stored yet
        return None
    return files.groupBy(FILE).agg(F.max(BATCH).alias(BATCH))


def _write(partial: DataFrame, files: DataFrame, store: str) -> str:
    """Store a batch; its list of files completes it."""
    batch = f"b{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    partial.write.parquet(f"{store}/rows/{BATCH}={batch}")
    files.select(FILE).coalesce(1).write.parquet(f"{store}/files/{BATCH}={batch}")
    return batch


def refresh(spark: SparkSession, part: Partials, source: str) -> list[str]:
    """Bring the stored partials of ``source`` up to date; the paths that were read."""
    store = _store(spark, part, source)
    listed, files = _listed(spark, store), _listing(spark, source)
    new = (files if listed is None else files.join(listed, FILE, "left_anti")).select(FILE, "path").collect()
    if not new and listed is None:
        raise ValueError(f"{source}: no files")
    if new:
        states = spark.createDataFrame([(r[FILE],) for r in new], f"{FILE} string")
        _write(part.of_files(spark, [r["path"] for r in new]), states, store)
    return sorted(r["path"] for r in new)


def _in_use(spark: SparkSession, part: Partials, source: str) -> tuple[DataFrame, DataFrame]:
    """The stored partials of the files that exist now, and the list of these files with their batches."""
    store = _store(spark, part, source)
    live = _listed(spark, store).join(_listing(spark, source).select(FILE).distinct(), FILE, "left_semi")
    rows = spark.read.parquet(f"{store}/rows")
    return rows.join(live, [FILE, BATCH], "left_semi"), live


def merged(spark: SparkSession, part: Partials, source: str) -> DataFrame:
    """The aggregate over all files of ``source`` after a refresh."""
    refresh(spark, part, source)
    return part.merge(_in_use(spark, part, source)[0])


def compact(spark: SparkSession, part: Partials, source: str) -> None:
    """Rewrite the partials in use as one batch and delete the others. No reader of the older batches may be at work."""
    store = _store(spark, part, source)
    rows, live = _in_use(spark, part, source)
    kept = _write(rows.drop(BATCH), live, store)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for kind in ("files", "rows"):  # the lists first: rows without a list aren't used
        folder = jvm.org.apache.hadoop.fs.Path(f"{store}/{kind}")
        fs = folder.getFileSystem(conf)
        for status in fs.listStatus(folder):
            if status.getPath().getName() < f"{BATCH}={kept}":
                fs.delete(status.getPath(), True)


def _csv(name: str) -> Callable[[SparkSession, list[str]], DataFrame]:
    return lambda spark, paths: read_csv_files(spark, paths, name)


ORDERS = Partials(
    "orders", _csv("orders"), ["order_id", "customer_id", "order_status", "order_purchase_timestamp"],
    prepare=lambda df: prepare.parse_timestamps(df, RAW_TIMESTAMPS["orders"]))
ITEMS = Partials(
    "order_items", _csv("order_items"), ["order_id"],
    {"gross": "price + freight_value", "product": "price", "freight": "freight_value"})
PAYMENTS = Partials(
    "order_payments", _csv("order_payments"), ["order_id", "payment_type", "payment_installments"],
    {"payments": "1", "value_sum": "payment_value", "value_n": "if(payment_value IS NULL, 0, 1)"})


def refreshed(spark: SparkSession, src: Sources, part: Partials) -> DataFrame:
    """The merged partials of one of the nine CSV sources."""
    return merged(spark, part, f"{folder_of(src, part.name).rstrip('/')}/{RAW_FILES[part.name]}")


def refreshed_orders(spark: SparkSession, src: Sources) -> Tables:
    """The refreshed orders as a ``Tables``, for the views' own helpers."""
    return Tables(orders=refreshed(spark, src, ORDERS))
