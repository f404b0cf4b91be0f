"""Date helpers with the dialect's semantics (DATEDIFF counts boundaries crossed)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.tsql import col


def datediff(unit: str, start, end) -> Column:
    """Number of ``unit`` boundaries crossed going from ``start`` to ``end``."""
    s, e = col(start), col(end)
    if unit == "day":
        return F.datediff(F.to_date(e), F.to_date(s)).cast("bigint")
    if unit == "month":
        return ((F.year(e) - F.year(s)) * 12 + F.month(e) - F.month(s)).cast("bigint")
    if unit == "year":
        return (F.year(e) - F.year(s)).cast("bigint")
    if unit == "hour":
        return (F.floor(F.unix_seconds(F.date_trunc("hour", e).cast("timestamp")) / 3600)
                - F.floor(F.unix_seconds(F.date_trunc("hour", s).cast("timestamp")) / 3600)).cast("bigint")
    if unit == "minute":
        return (F.floor(F.unix_seconds(F.date_trunc("minute", e).cast("timestamp")) / 60)
                - F.floor(F.unix_seconds(F.date_trunc("minute", s).cast("timestamp")) / 60)).cast("bigint")
    raise ValueError(unit)


def dateadd(unit: str, n: int, c) -> Column:
    """DATEADD(unit, n, c)."""
    c = col(c)
    if unit == "day":
        return c + F.make_interval(days=F.lit(n))
    if unit == "month":
        return c + F.make_interval(months=F.lit(n))
    if unit == "hour":
        return c + F.make_interval(hours=F.lit(n))
    if unit == "minute":
        return c + F.make_interval(mins=F.lit(n))
    raise ValueError(unit)


def datename(part: str, c) -> Column:
    """DATENAME(weekday | month, c) in English."""
    return F.date_format(col(c), {"weekday": "EEEE", "month": "MMMM"}[part])
