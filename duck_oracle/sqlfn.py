"""SQL text helpers mirroring ``feira.functions`` (same rounding recipe, written as SQL)."""

from __future__ import annotations


def R(num: str, den: str, d: int) -> str:
    """ROUND(num / den, d) via DOUBLE division and DECIMAL(38,10), as DOUBLE."""
    return (
        f"cast(round(cast(cast({num} as double) / cast(nullif({den}, 0) as double) as decimal(38,10)), {d}) as double)"
    )


def RP(num: str, den: str, d: int, scale: int = 100) -> str:
    """ROUND(num / den * scale, d) in that order of operations."""
    return (
        f"cast(round(cast(cast({num} as double) / cast(nullif({den}, 0) as double) * cast({scale} as double)"
        f" as decimal(38,10)), {d}) as double)"
    )


def RD(x: str, d: int) -> str:
    """ROUND of a DOUBLE through DECIMAL(38,10)."""
    return f"cast(round(cast({x} as decimal(38,10)), {d}) as double)"


def M(x: str) -> str:
    """Money: ROUND(x, 2) as DOUBLE."""
    return f"cast(round({x}, 2) as double)"


def IAVG(x: str) -> str:
    """T-SQL AVG(int): truncated toward zero (DuckDB's // truncates)."""
    return f"cast(sum({x}) // nullif(count({x}), 0) as bigint)"


def DD(a: str, b: str) -> str:
    """T-SQL DATEDIFF(DAY, a, b): calendar-date difference."""
    return f"date_diff('day', cast({a} as date), cast({b} as date))"


def MONTH_START(ts: str) -> str:
    """DATEFROMPARTS(YEAR(ts), MONTH(ts), 1)."""
    return f"make_date(year({ts}), month({ts}), 1)"


def TB(key: str) -> str:
    """Tie-break order used by the Spark ranking operator."""
    return f"md5(cast({key} as varchar)) asc nulls first, {key} asc nulls first"
