"""Order-insensitive exact comparison of two pandas frames (the driver's check, made strict)."""

from __future__ import annotations

import math

import pandas as pd


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "<NULL>"
    if isinstance(v, float) and math.isnan(v):
        return "<NULL>"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v.is_integer():
        v = int(v)  # nullable integer columns arrive as float64 from Spark, Int64 from DuckDB
    return repr(v)


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def assert_same(spark_df: pd.DataFrame, oracle_df: pd.DataFrame, label: str = "") -> None:
    assert sorted(spark_df.columns) == sorted(oracle_df.columns), (label, spark_df.columns, oracle_df.columns)
    assert len(spark_df) == len(oracle_df), (label, len(spark_df), len(oracle_df))
    a, b = canonical(spark_df), canonical(oracle_df)
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    assert not diff, (label, diff)
