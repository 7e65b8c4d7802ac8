"""Numeric helpers whose results are bit-identical in Spark and in the SQL oracle.

Every rounded ratio goes through the same steps on both sides: DOUBLE division,
cast to DECIMAL(38,10), HALF_UP rounding to ``digits``, result as DOUBLE.
Rounding a DOUBLE directly differs between engines (1.005 -> 1.01 or 1.0);
going through DECIMAL does not. Division by zero yields NULL (``NULLIF``),
which also keeps ANSI mode from raising.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _round_via_decimal(x: Column, digits: int) -> Column:
    return F.round(x.cast("decimal(38,10)"), digits).cast("double")


def round_double(x: ColumnOrName, digits: int) -> Column:
    """ROUND of a DOUBLE value, engine-independent (through DECIMAL(38,10))."""
    return _round_via_decimal(col(x).cast("double"), digits)


def ratio_round(num: ColumnOrName, den: ColumnOrName, digits: int) -> Column:
    """ROUND(num / den, digits); num/den evaluated as DOUBLE."""
    q = col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))
    return _round_via_decimal(q, digits)


def ratio_pct_round(num: ColumnOrName, den: ColumnOrName, digits: int, scale: float = 100.0) -> Column:
    """ROUND(num / den * scale, digits) — the reference's ``x / y * 100`` order of operations."""
    q = col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))
    return _round_via_decimal(q * F.lit(float(scale)), digits)


def money(c: ColumnOrName) -> Column:
    """ROUND(exact decimal sum, 2) reported as DOUBLE."""
    return F.round(col(c), 2).cast("double")


def int_div(num: str, den: str) -> Column:
    """Integer quotient truncated toward zero, NULL when ``den`` is 0.

    This is T-SQL ``AVG(int)`` once ``num`` = sum and ``den`` = count. Both
    arguments are column names of an already aggregated frame.
    """
    return F.expr(f"`{num}` div nullif(`{den}`, 0)")


def sample_stdev(n: ColumnOrName, s: ColumnOrName, ss: ColumnOrName) -> Column:
    """Sample standard deviation from exact integer moments (count, sum, sum of squares).

    The numerator n*ss - s*s is an exact integer, so the DOUBLE result does
    not depend on the order in which partitions were merged. NULL for n < 2.
    """
    n, s, ss = col(n), col(s), col(ss)
    num = (n * ss - s * s).cast("double")
    den = F.nullif((n * (n - F.lit(1))).cast("double"), F.lit(0.0))
    return F.sqrt(num / den)


def count_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END) — 0 on empty input, never NULL."""
    return F.count_if(F.coalesce(cond, F.lit(False)))
