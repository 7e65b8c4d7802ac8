"""The stored prepared tables: reuse within an application and the optional bucketed layout."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from feira import load_tables
from feira.plans import revenue
from feira.sources import warehouse
from tests.compare import assert_same
from tests.conftest import SF_SMALL


def test_store_is_written_once_and_reused(spark):
    first = warehouse.warehouse_tables(spark, SF_SMALL)
    again = warehouse.warehouse_tables(spark, SF_SMALL)
    assert first.orders is again.orders
    assert first.orders.count() == load_tables(spark, SF_SMALL).orders.count()


def test_bucketed_layout_gives_the_same_view_without_order_id_shuffles(spark, duck_sf_small):
    t = warehouse.warehouse_tables(spark, SF_SMALL, bucketed=True)
    got = entry.normalise(revenue.revenue_trends(t)).toPandas()
    want = duck_sf_small.sql(entry.oracle_sql()["v01_revenue_trends"]).df()
    assert_same(got, want, "v01 on bucketed store")
    plan = t.order_items.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert not re.search(r"Exchange hashpartitioning\(order_id", plan)


def test_changed_input_gives_the_new_result(spark, tmp_path):
    """The fingerprint is taken on every call: a source replaced under the same path is seen."""
    import shutil

    import pyarrow.parquet as pq

    folder = tmp_path / "sf"
    shutil.copytree(SF_SMALL, folder)
    (folder / "orders.parquet").chmod(0o644)
    before = warehouse.warehouse_tables(spark, str(folder)).orders.count()
    whole = pq.read_table(f"{SF_SMALL}/orders.parquet")
    half = whole.slice(0, whole.num_rows // 2)
    pq.write_table(half, folder / "orders.parquet")
    after = warehouse.warehouse_tables(spark, str(folder)).orders.count()
    assert after == half.num_rows < before


def test_a_csv_query_writes_its_own_sources_only(spark, tmp_path, monkeypatch):
    """Each source has a store of its own: a query exports what it reads, in compressed files of bounded length."""
    from feira.sources import csv_io

    monkeypatch.setattr(warehouse, "_root", lambda s: str(tmp_path))
    monkeypatch.setattr(csv_io, "ROWS_PER_COMPRESSED_FILE", 200)
    rows = load_tables(spark, SF_SMALL).order_items.count()
    assert entry.queries()["s10_order_items"](spark, SF_SMALL).count() == rows > 200
    assert {p.name for store in tmp_path.iterdir() for p in store.iterdir()} == {"order_items"}
    assert len(list(tmp_path.glob("raw-csv-*/order_items/*/*.csv/*.csv.gz"))) >= rows // 200
    assert entry.queries()["s10_products"](spark, SF_SMALL).count() > 0
    assert {p.name for p in next(tmp_path.glob("raw-csv-*")).iterdir()} == {"order_items", "products", "categories"}


def test_a_view_stores_the_tables_it_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "_root", lambda s: str(tmp_path))
    monkeypatch.setattr(warehouse, "_opened", {})
    assert entry.queries()["v16_installments_analysis"](spark, SF_SMALL).count() == 12
    assert {p.name for p in next(tmp_path.iterdir()).iterdir()} == {"orders", "order_payments", "order_reviews"}
