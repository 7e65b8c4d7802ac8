"""Publishing views for SQL consumers (S-11) and reading them back (S-12, S-13)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from feira.sources.bridge import Tables

# The consumer projection the reference runs after creating the revenue view.
REVENUE_TREND_COLUMNS = [
    "month_start", "total_orders", "gross_revenue", "aov", "mom_growth_pct", "yoy_growth_pct", "ytd_revenue",
]


def publish_views(t: Tables, names: Iterable[str] | None = None) -> list[str]:
    """S-11: register the analytical views as temporary views named like the reference's.

    Views backed by global rankings materialise their ranked input when
    published (see ``feira.operators.ranking``); the others stay lazy.
    """
    from feira.plans import VIEWS

    chosen = list(VIEWS) if names is None else list(names)
    for name in chosen:
        VIEWS[name](t).createOrReplaceTempView(name)
    return chosen


def scan_view(spark: SparkSession, name: str) -> DataFrame:
    """S-12 ``SELECT * FROM vw_...``."""
    return spark.table(name)


def revenue_trend_projection(spark: SparkSession) -> DataFrame:
    """S-13 the reference's projection of ``vw_revenue_trends``."""
    return spark.table("vw_revenue_trends").select(*REVENUE_TREND_COLUMNS)
