"""Date helpers with T-SQL boundary-crossing semantics.

``DATEDIFF(DAY, a, b)`` counts midnights crossed, i.e. the difference of the
calendar dates; the two-argument Spark ``datediff(end, start)`` does exactly
that (the three-argument form counts elapsed 24-hour units instead).
``DATEDIFF(MONTH, a, b)`` counts month boundaries crossed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feira.functions.numeric import ColumnOrName, col


def first_of_month(ts: ColumnOrName) -> Column:
    """DATEFROMPARTS(YEAR(ts), MONTH(ts), 1) as DATE (``date_trunc`` would return a zoned TIMESTAMP)."""
    return F.trunc(col(ts), "month")


def day_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """DATEDIFF(DAY, start, end) as BIGINT; NULL if either side is NULL."""
    return F.datediff(col(end), col(start)).cast("bigint")


def month_diff(start: ColumnOrName, end: ColumnOrName) -> Column:
    """DATEDIFF(MONTH, start, end) as BIGINT."""
    s, e = col(start), col(end)
    return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("bigint")


def lenient_timestamp(c: ColumnOrName) -> Column:
    """pandas ``to_datetime(errors='coerce')``: unparseable text becomes NULL.

    ``try_cast`` to TIMESTAMP_NTZ keeps the value zone-free and never raises
    under ANSI mode.
    """
    return col(c).try_cast("timestamp_ntz")
