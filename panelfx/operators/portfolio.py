"""Portfolio accounting: returns, turnover, costs and account series from long weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cumprod, div
from .joins import asof_join

DAY, KEY = "trade_date", "code_id"


def held_on(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """trade_date, code_id, weight: the weights of the latest selection at or before each date. Selections and dates are
    matched first (a row each), then joined."""
    sel = weights.select("select_date").distinct().withColumn("__to", F.lead("select_date").over(Window.orderBy("select_date")))
    span = dates.select(DAY).distinct().join(F.broadcast(sel), (F.col(DAY) >= F.col("select_date")) & (F.col("__to").isNull() | (F.col(DAY) < F.col("__to")))).select(DAY, "select_date")
    return weights.join(F.broadcast(span), "select_date").groupBy(DAY, KEY).agg(F.sum("weight").alias("weight"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, ret: str = "ret") -> DataFrame:
    """trade_date, ret: sum of weight * return; codes without a return add 0."""
    held = held_on(weights, returns)
    return held.join(returns.select(DAY, KEY, F.col(ret).alias("__r")), [DAY, KEY], "left").groupBy(DAY).agg(F.sum(F.col("weight") * F.coalesce("__r", F.lit(0.0))).alias("ret"))


def execution_price(rule: str) -> tuple[Column, Column]:
    """(sell, buy) price expressions of a rule over a code's rows: `open` is the next open, `close` this close,
    `close-open` sells at this close and buys at the next open, `HHMM-HHMM` takes the next day's minute columns cHHMM."""
    w = Window.partitionBy(KEY).orderBy(DAY)
    nxt = lambda c: F.lead(c).over(w)
    if rule == "open":
        return nxt("open"), nxt("open")
    if rule == "close":
        return F.col("close"), F.col("close")
    if rule == "close-open":
        return F.col("close"), nxt("open")
    sell, buy = rule.split("-")
    return nxt(f"c{sell}"), nxt(f"c{buy}")


def holding_return(panel: DataFrame, rule: str) -> DataFrame:
    """Adds sell, buy and ret: from buying at a row's rule to selling at the next row's."""
    sell, buy = execution_price(rule)
    out = panel.withColumns({"sell": sell, "buy": buy})
    return out.withColumn("ret", div(F.lead("sell").over(Window.partitionBy(KEY).orderBy(DAY)), "buy") - 1)


def turnover_cost(weights: DataFrame, commission: float = 0.00012, stamp: float = 0.001) -> DataFrame:
    """select_date, buy, sell (turnover against the rebalance before), cost: commission on both, stamp tax on sales. A code
    that enters or leaves has weight 0 on the other side: each weight row is seen once as new and once, at the next
    rebalance, as old."""
    order = weights.select("select_date").distinct().withColumn("__next", F.lead("select_date").over(Window.orderBy("select_date")))
    rows = weights.join(F.broadcast(order), "select_date")
    sides = F.array(F.struct(F.col("select_date").alias("select_date"), F.col("weight").alias("d")), F.struct(F.col("__next").alias("select_date"), (-F.col("weight")).alias("d")))
    seen = rows.select(KEY, F.explode(sides).alias("s")).select(KEY, "s.select_date", "s.d").where("select_date is not null")
    delta = seen.groupBy("select_date", KEY).agg(F.sum("d").alias("d"))
    by = delta.groupBy("select_date").agg(F.sum(F.greatest("d", F.lit(0.0))).alias("buy"), F.sum(F.greatest(-F.col("d"), F.lit(0.0))).alias("sell"))
    return by.withColumn("cost", (F.col("buy") + F.col("sell")) * commission + F.col("sell") * stamp)


def net_returns(gross: DataFrame, costs: DataFrame) -> DataFrame:
    """trade_date, gross, cost, net: a rebalance's cost falls on its date."""
    return gross.join(costs.select(F.col("select_date").alias(DAY), "cost"), DAY, "left").select(DAY, F.col("ret").alias("gross"), F.coalesce("cost", F.lit(0.0)).alias("cost"), (F.col("ret") - F.coalesce("cost", F.lit(0.0))).alias("net"))


def limit_down_carry(exits: DataFrame, bars: DataFrame) -> DataFrame:
    """Adds exit_date: the first bar of the code on or after the planned date with close above the down limit. A forward
    as-of join: time runs backwards through negated day numbers."""
    days = lambda c: -F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
    free = bars.where(F.col("close") > F.col("down_limit")).select(KEY, days(DAY).alias("__n"), F.col(DAY).alias("exit_date"))
    return asof_join(exits.withColumn("__p", days("planned")), free, KEY, "__p", "__n", ["exit_date"]).drop("__p")


def account_series(account: DataFrame, initial: float, by: list[str] | None = None, day: str = DAY) -> DataFrame:
    """From cash, position_value, commission and tax: total, nav, fee, pct_change (against the row before, the initial
    value first) and leverage."""
    w = Window.partitionBy(*(by or [])).orderBy(day)
    out = account.withColumn("total", F.col("cash") + F.col("position_value")).withColumn("nav", F.col("total") / initial).withColumn("fee", F.col("commission") + F.col("tax"))
    return out.withColumns({"pct_change": div("total", F.lag("total", 1, initial).over(w)) - 1, "leverage": div("position_value", "total")})


def benchmark_curve(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """trade_date, nav, bench: running products of both series; dates without a benchmark return count 0."""
    both = returns.join(benchmark.select(DAY, F.col("ret").alias("__b")), DAY, "left").withColumn("__one", F.lit(1))
    run = lambda c: cumprod(1 + F.coalesce(c, F.lit(0.0)), "__one", DAY)
    return both.select(DAY, run(F.col("ret")).alias("nav"), run(F.col("__b")).alias("bench"))


def equity_timing(weights: DataFrame, curve: DataFrame, n: int = 3, low: float = 0.5) -> DataFrame:
    """Weights scaled by a signal of the account curve (trade_date, nav): 1 where the nav known at the selection (that of
    the date before at the latest) is at or above its mean of n dates, else `low`."""
    w = Window.orderBy(DAY)
    sig = curve.withColumn("signal", F.when(F.col("nav") >= F.avg("nav").over(w.rowsBetween(-(n - 1), 0)), 1.0).otherwise(low)).withColumn("signal", F.lag("signal", 1, 1.0).over(w))
    return weights.join(F.broadcast(sig.select(F.col(DAY).alias("select_date"), "signal")), "select_date", "left").withColumn("weight", F.col("weight") * F.coalesce("signal", F.lit(1.0))).drop("signal")


def strategy_sweep(scored: DataFrame, settings: DataFrame, ret: str = "next_return") -> DataFrame:
    """One row a setting (config_id, n, timing): mean return, deviation, and dates, of equally weighted portfolios of the
    n smallest scores. All settings share one ranking; a row is copied only to the settings that select it."""
    ranked = scored.withColumn("__r", F.when(F.col("score").isNotNull(), F.rank().over(Window.partitionBy(DAY).orderBy(F.asc_nulls_last("score")))))
    hit = ranked.join(F.broadcast(settings), F.col("__r") <= F.col("n"))
    by_date = hit.groupBy("config_id", DAY).agg((F.avg(ret) * F.first("timing")).alias("r"))
    return by_date.groupBy("config_id").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("dates"))
