"""Driver contract: every registered query equals its DuckDB oracle (here at sf0.001)."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from tests.compare import assert_same
from tests.conftest import SF_SMALL

# the optional corpus operators (op1_.., pipeline) have tests of their own
QUERIES = {k: q for k, q in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if k in QUERIES}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[0] == "month_start"


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck_sf_small, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = duck_sf_small.sql(ORACLE[key]).df()
    assert_same(got, want, key)


def test_value_counts_are_ordered(spark):
    rows = QUERIES["p10_status_counts"](spark, SF_SMALL).collect()
    assert [tuple(r) for r in rows] == sorted((tuple(r) for r in rows), key=lambda r: (-r[1], r[0]))


def test_retention_matrix_holds_every_cohort_cell(spark):
    cells = {(r.cohort_month, r.month_number): r.retention_rate_pct for r in QUERIES["v05_cohort_retention"](spark, SF_SMALL).collect()}
    matrix = {(r.cohort_month, r.month_number): r.retention_rate_pct for r in QUERIES["m07_retention_matrix"](spark, SF_SMALL).collect()}
    assert {k: v for k, v in matrix.items() if v is not None} == cells
    assert max(m for _, m in cells) > 12
    assert len(matrix) == len({c for c, _ in cells}) * (1 + max(m for _, m in cells))


def test_scores_are_shared_by_the_three_person_rankings(spark):
    from feira.plans import customers
    from feira.sources.warehouse import warehouse_tables

    t = warehouse_tables(spark, SF_SMALL)
    assert customers.rfm_scores(t) is customers.rfm_scores(warehouse_tables(spark, SF_SMALL))
