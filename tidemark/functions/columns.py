"""Columns over a series that is keyed by `symbol` and ordered by `date`. All share one partitioning and sort."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

TRADING_DAYS, RISK_FREE = 252, 0.035
YEAR = 252**0.5


def ordered(key: str = "symbol", by: str = "date"):
    return Window.partitionBy(key).orderBy(by)


def trailing(n: int, key: str = "symbol", by: str = "date"):
    """The last n rows, this one included."""
    return ordered(key, by).rowsBetween(-(n - 1), 0)


def so_far(key: str = "symbol", by: str = "date"):
    return ordered(key, by).rowsBetween(Window.unboundedPreceding, 0)


def ratio(a, b) -> Column:
    """a / b, or null where b is 0."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return col(a) / F.nullif(col(b), F.lit(0.0))


def change(x, n: int = 1, key: str = "symbol", by: str = "date") -> Column:
    """Relative change against the row n before."""
    col = F.col(x) if isinstance(x, str) else x
    before = F.lag(col, n).over(ordered(key, by))
    return (col - before) / F.nullif(before, F.lit(0.0))


def gated(what, x: str, n: int, least: int, key: str = "symbol", by: str = "date") -> Column:
    """An aggregate of the last n rows, null until `least` of them have a value."""
    w = trailing(n, key, by)
    return F.when(F.count(x).over(w) >= least, what(x).over(w))


def drawdown(x: str, key: str = "symbol", by: str = "date") -> Column:
    """Relative distance from the greatest value so far, 0 or less."""
    peak = F.max(x).over(so_far(key, by))
    return (F.col(x) - peak) / F.nullif(peak, F.lit(0.0))


def rounded(x, digits: int = 6) -> Column:
    """Half away from zero, also where binary holds a decimal half a little short of it; never -0.0."""
    return F.round((F.col(x) if isinstance(x, str) else x) * (1 + 2.0**-43), digits) + F.lit(0.0)


def percentage_change(now: Column, before: Column, digits: int = 6) -> Column:
    return F.round((now - before) / F.nullif(before, F.lit(0.0)), digits)
