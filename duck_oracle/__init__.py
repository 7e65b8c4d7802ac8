"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each entry is self-contained: it derives the reference-shaped tables from the
driver's parquet views (``fixtures``) and then computes the result directly
over the joined rows (review fan-out included), independently of the Spark
plans' weighted rewrites.
"""

from __future__ import annotations

from duck_oracle.fixtures import with_fixtures
from duck_oracle.metrics import METRICS
from duck_oracle.quality import QUALITY
from duck_oracle.sources import SOURCES
from duck_oracle.views import VIEWS


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in (VIEWS, QUALITY, METRICS, SOURCES):
        for key, body in group.items():
            out[key] = with_fixtures(body)
    return out
