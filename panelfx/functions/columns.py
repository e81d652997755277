"""Column expressions shared by the operators. Missing is NULL, never NaN; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x) -> Column:
    """NaN and infinities become NULL."""
    x = _c(x)
    return F.when(~(F.isnan(x) | x.isin(float("inf"), float("-inf"))), x)


def div(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(_c(a), _c(b))


def cap(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), _c(lo)), _c(hi))


def _places(x, n: int) -> Column:
    k = float(10**n)
    return F.floor(_c(x) * k + 0.5) / k


def r2(x) -> Column:
    return _places(x, 2)


def r4(x) -> Column:
    return _places(x, 4)


def r6(x) -> Column:
    """Half-up at 6 places, the same in any engine."""
    return _places(x, 6)


def trailing(keys, order, n: int):
    """The frame of the last n rows of each key."""
    keys = [keys] if isinstance(keys, str) else keys
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)


def rolling(fn, x, keys, order, n: int, full: bool = True) -> Column:
    """fn over the last n rows; NULL until n values are there (full)."""
    w = trailing(keys, order, n)
    out = fn(_c(x)).over(w)
    return F.when(F.count(_c(x)).over(w) == n, out) if full else out


def ffill(x, keys, order) -> Column:
    keys = [keys] if isinstance(keys, str) else keys
    return F.last(_c(x), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def cumprod(x, keys, order) -> Column:
    """Running product of positive factors (NULL counts as 1)."""
    keys = [keys] if isinstance(keys, str) else keys
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log(_c(x))).over(w))


def min_rank(x, keys, ascending: bool = True) -> Column:
    """Rank, ties sharing the smallest; NULL has no rank."""
    keys = [keys] if isinstance(keys, str) else keys
    x = _c(x)
    order = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)))


def avg_rank(x, keys, ascending: bool = True) -> Column:
    """Rank, ties sharing the average; NULL has no rank."""
    keys = [keys] if isinstance(keys, str) else keys
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, _c(x)))
    return min_rank(x, keys, ascending) + (ties - 1) / 2
