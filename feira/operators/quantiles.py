"""Exact interpolated quantiles without holding a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer; over a whole large table that buffer is unbounded. Here
the columns are checkpointed and counted, and the values at the two neighbours of each quantile position are
found by narrowing (``operators.selection``: cut points from a sample, one count of the classes of all
columns, equal values counted in the classes that hold a position) and
interpolated — the definition pandas and ``percentile`` use:
position = (n - 1) * p, value = (hi - pos) * x_lo + (pos - lo) * x_hi with
lo/hi its floor/ceiling. No row is ranked; the sample, the class counts and the found values travel to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.operators.selection import sampled_cuts, sizes_of, values_at
from feira.session import materialize


def exact_quantiles_many(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows ``(column_name, p, value)`` for every column and probability (values as DOUBLE, NULLs ignored).

    ``value`` is NULL for a column without non-NULL values.
    """
    names = [f"x{i}" for i in range(len(columns))]
    values = materialize(
        df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)]).withColumn(
            "_k", F.monotonically_increasing_id()  # fixed once by the checkpoint
        )
    )
    sizes = sizes_of(values, names)
    places = {}
    for n in names:
        nulls, present = sizes.rows - sizes.present[n], sizes.present[n]
        spots = [(present - 1) * float(p) for p in probs] if present else []
        places[n] = sorted({nulls + at for pos in spots for at in (math.floor(pos), math.ceil(pos))})
    found = values_at(values, places, sampled_cuts(values, "_k", names, sizes), sizes) if sizes.rows else {}
    rows = []
    for c, n in zip(columns, names):
        nulls, present = sizes.rows - sizes.present[n], sizes.present[n]
        for p in probs:
            value = None
            if present:
                pos = (present - 1) * float(p)
                lo, hi = math.floor(pos), math.ceil(pos)
                x_lo, x_hi = found[n, nulls + lo].value, found[n, nulls + hi].value
                value = x_lo if x_lo == x_hi else (float(hi) - pos) * x_lo + (pos - float(lo)) * x_hi
            rows.append((c, float(p), value))
    return df.sparkSession.createDataFrame(rows, "column_name string, p double, value double")


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """One row per probability, ``(p, value)``, over the non-NULL values of ``column`` as DOUBLE."""
    return exact_quantiles_many(df, [column], probs).select("p", "value")
