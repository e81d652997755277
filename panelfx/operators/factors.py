"""Time-series factors and the label: expressions over a code's rows in date order, NULL until a window is full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, rolling

KEY, DAY = "code_id", "trade_date"


def _w():
    return Window.partitionBy(KEY).orderBy(DAY)


def label_fwd_return(n: int, open_: str = "open") -> Column:
    """open[t + n + 1] / open[t + 1] - 1."""
    return div(F.lead(open_, n + 1).over(_w()), F.lead(open_, 1).over(_w())) - 1


def close_std(n: int, close: str = "close") -> Column:
    return rolling(F.stddev_samp, close, KEY, DAY, n)


def amount_shrink(windows: tuple[int, int] = (3, 20), amount: str = "amount") -> Column:
    """Mean amount over the short window to that over the long one."""
    return div(rolling(F.avg, amount, KEY, DAY, windows[0]), rolling(F.avg, amount, KEY, DAY, windows[1]))


def drawdown(n: int, close: str = "close") -> Column:
    return div(close, rolling(F.max, close, KEY, DAY, n)) - 1


def sharpe(n: int, ret: str = "pct_change") -> Column:
    """Mean of the returns over their sample deviation; NULL for a deviation of (nearly) 0."""
    std = rolling(F.stddev_samp, ret, KEY, DAY, n)
    return F.when(std > 1e-12, rolling(F.avg, ret, KEY, DAY, n) / std)


def big_order_net(n: int, buy: str = "big_buy", sell: str = "big_sell", amount: str = "amount") -> Column:
    return div(rolling(F.sum, F.col(buy) - F.col(sell), KEY, DAY, n), rolling(F.sum, amount, KEY, DAY, n))


def turnover_mean(n: int, turnover: str = "turnover") -> Column:
    return rolling(F.avg, turnover, KEY, DAY, n)


def amount_mean(n: int, amount: str = "amount") -> Column:
    return rolling(F.avg, amount, KEY, DAY, n)


def amount_std(n: int, amount: str = "amount") -> Column:
    return rolling(F.stddev_samp, amount, KEY, DAY, n)


def momentum(n: int, close: str = "close") -> Column:
    return div(close, F.lag(close, n).over(_w())) - 1


def buy_share(buy: str, buys: list[str]) -> Column:
    """One class's buying as a share of all classes'."""
    return div(buy, sum((F.col(b) for b in buys[1:]), F.col(buys[0])))


def value_ratios(profit: str = "profit_q", revenue: str = "revenue_q", equity: str = "equity", mv: str = "total_mv") -> dict[str, Column]:
    return {"ep": div(profit, mv), "sp": div(revenue, mv), "bm": div(equity, mv)}


FACTORS: dict[str, Callable[..., Column]] = {
    "label_fwd_return": label_fwd_return, "close_std": close_std, "amount_shrink": amount_shrink, "drawdown": drawdown, "sharpe": sharpe, "big_order_net": big_order_net,
    "turnover": turnover_mean, "amount_mean": amount_mean, "amount_std": amount_std, "momentum": momentum,
}


def add_factors(panel: DataFrame, wanted: list[tuple]) -> DataFrame:
    """Adds factors (name, parameter[, column name]) in one select: windows of the same keys share an exchange."""
    return panel.select("*", *(FACTORS[n](p).alias(as_[0] if as_ else f"{n}_{'_'.join(map(str, p)) if isinstance(p, tuple) else p}") for n, p, *as_ in wanted))
