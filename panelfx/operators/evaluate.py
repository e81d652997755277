"""Evaluation of factors and predictions: information coefficients, top-n portfolios, performance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import avg_rank
from .cross_section import excess_return

DAY = "trade_date"


def _pairs(df: DataFrame, pred: str, ret: str) -> DataFrame:
    return df.where(F.col(pred).isNotNull() & F.col(ret).isNotNull())


def pearson_ic(df: DataFrame, pred: str = "pred", ret: str = "ret", more: tuple[str, ...] = ()) -> DataFrame:
    """trade_date (and the columns `more`), ic: Pearson correlation over complete pairs; dates with one row or without
    spread are left out."""
    by = _pairs(df, pred, ret).groupBy(DAY, *more)
    # not corr(), which fails on a date without spread
    ic = F.try_divide(F.covar_pop(pred, ret), F.stddev_pop(pred) * F.stddev_pop(ret))
    both = by.agg(ic.alias("ic"), F.count_distinct(pred).alias("a"), F.count_distinct(ret).alias("b"))
    return both.where("a >= 2 and b >= 2").select(DAY, *more, "ic")


def rank_ic(df: DataFrame, pred: str = "pred", ret: str = "ret", more: tuple[str, ...] = ()) -> DataFrame:
    """As pearson_ic, of the average ranks (Spearman)."""
    by = [DAY, *more]
    ranked = _pairs(df, pred, ret).select(*by, avg_rank(pred, by).alias("__p"), avg_rank(ret, by).alias("__r"))
    return pearson_ic(ranked, "__p", "__r", more)


def ic_summary(ic: DataFrame) -> DataFrame:
    """mean, sample deviation, ratio of both, share above 0."""
    out = ic.agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("win"), F.count("ic").alias("n"))
    return out.select("mean", "std", F.when(F.col("std") > 0, F.col("mean") / F.col("std")).alias("ir"), "win", "n")


def relative_ic(df: DataFrame, pred: str = "pred", ret: str = "ret") -> DataFrame:
    return rank_ic(df.withColumn("__x", excess_return(ret)), pred, "__x")


def cumulative_ic(ic: DataFrame) -> DataFrame:
    """Running sum of the daily IC (one row a date, so one small ordered window)."""
    return ic.withColumn("cum_ic", F.sum("ic").over(Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)))


def topn_daily(df: DataFrame, sizes: list[int], pred: str = "pred", ret: str = "ret", tie: str = "code_id") -> DataFrame:
    """trade_date, topN mean returns of the N largest predictions for each N, and market (all rows)."""
    rn = F.row_number().over(Window.partitionBy(DAY).orderBy(F.desc_nulls_last(pred), tie))
    return df.withColumn("__rn", rn).groupBy(DAY).agg(*(F.avg(F.when(F.col("__rn") <= n, F.col(ret))).alias(f"top{n}") for n in sizes), F.avg(ret).alias("market"))


def every_kth_date(df: DataFrame, k: int) -> DataFrame:
    """Rows of every k-th distinct date, the first included. The dates are ranked on their own (a row each)."""
    dates = df.select(DAY).distinct().withColumn("__k", (F.row_number().over(Window.orderBy(DAY)) - 1) % k).where("__k = 0").select(DAY)
    return df.join(F.broadcast(dates), DAY, "left_semi")


def topn_history(df: DataFrame, sizes: list[int], pred: str = "pred", ret: str = "ret", code: str = "code_id") -> DataFrame:
    """trade_date, portfolio, rank, code, ret, pred for each N."""
    rn = F.row_number().over(Window.partitionBy(DAY).orderBy(F.desc_nulls_last(pred), code))
    ranked = df.withColumn("rank", rn).where(F.col("rank") <= max(sizes))
    return ranked.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= n").select(DAY, F.concat(F.lit("top"), "n").alias("portfolio"), "rank", code, ret, pred)


def long_returns(wide: DataFrame) -> DataFrame:
    """trade_date, portfolio, ret of a table with a column for each portfolio."""
    return wide.unpivot([DAY], [c for c in wide.columns if c != DAY], "portfolio", "ret")


def topn_performance(returns: DataFrame, holding_days: int, periods_per_year: float = 250.0) -> DataFrame:
    """For each portfolio of (trade_date, portfolio, ret): total, annual (1 + total)^(periods_per_year / rows) - 1,
    volatility, Sharpe, largest drawdown, win rate, mean."""
    run = Window.partitionBy("portfolio").orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    nav = F.exp(F.sum(F.log(1 + F.col("ret"))).over(run))
    r = returns.where(F.col("ret").isNotNull() & (F.col("ret") > -1)).withColumn("nav", nav)
    r = r.withColumn("dd", F.col("nav") / F.greatest(F.max("nav").over(run), F.lit(1.0)) - 1)
    by = r.groupBy("portfolio").agg(
        (F.exp(F.sum(F.log(1 + F.col("ret")))) - 1).alias("total"), F.stddev_samp("ret").alias("sd"), F.min("dd").alias("max_drawdown"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("mean"), F.count("*").alias("n"),
    )
    annual = F.pow(1 + F.col("total"), F.lit(periods_per_year) / F.col("n")) - 1
    vol = F.col("sd") * (periods_per_year / holding_days) ** 0.5
    return by.select("portfolio", "total", annual.alias("annual"), vol.alias("vol"), F.when(vol > 0, annual / vol).alias("sharpe"), "max_drawdown", "win_rate", "mean")


def topn_excess(wide: DataFrame, portfolio: str) -> DataFrame:
    """Running sum of the portfolio's return less the market's."""
    return wide.select(DAY, F.sum(F.col(portfolio) - F.col("market")).over(Window.orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)).alias("cum_excess"))


def period_returns(returns: DataFrame, unit: str = "month", ret: str = "ret") -> DataFrame:
    """Compounded return of each calendar unit from the first to the last; units without rows have 0."""
    by = returns.groupBy(F.trunc(DAY, unit).alias("period")).agg((F.exp(F.sum(F.log(1 + F.col(ret)))) - 1).alias("ret"))
    step = {"month": "1 month", "quarter": "3 months", "year": "1 year"}[unit]
    span = by.agg(F.explode(F.sequence(F.min("period"), F.max("period"), F.expr(f"interval {step}"))).alias("period"))
    return span.join(by, "period", "left").select("period", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def performance_summary(curve: DataFrame, periods_per_year: float | None = None, day: str = DAY, ret: str = "ret") -> DataFrame:
    """One row for a series of period returns (a row a date): nav, annual (by calendar days), sharpe (on a year's periods:
    rows / days * 365, unless given), max_drawdown with its
    start and end, return over drawdown, win rate with and without zero returns, profit over loss, best, worst, longest
    winning and losing runs (0 if there is none), deviation."""
    c = curve.select(F.col(day).alias("d"), F.col(ret).alias("r")).withColumn("nav", F.exp(F.sum(F.log(1 + F.col("r"))).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))))
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("peak", F.max(F.struct("nav", F.date_diff(F.lit("1970-01-01").cast("date"), F.col("d").cast("date")).alias("neg"), F.col("d").alias("at"))).over(run))
    c = c.withColumn("dd", F.col("nav") / F.col("peak.nav") - 1)
    sign = F.signum("r")
    c = c.withColumn("grp", F.row_number().over(Window.orderBy("d")) - F.row_number().over(Window.partitionBy(sign).orderBy("d")))
    c = c.withColumn("len", F.count("*").over(Window.partitionBy(F.signum("r"), "grp")))
    low = F.min(F.struct("dd", "d", F.col("peak.at").alias("start")))
    out = c.agg(
        F.max_by("nav", "d").alias("nav"), F.datediff(F.max("d"), F.min("d")).alias("days"), F.avg("r").alias("m"), F.count("r").alias("n"), F.stddev_samp("r").alias("std"), low.alias("low"),
        F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), (F.sum((F.col("r") > 0).cast("double")) / F.nullif(F.sum((F.col("r") != 0).cast("double")), F.lit(0.0))).alias("win_rate_traded"),
        (F.avg(F.when(F.col("r") > 0, F.col("r"))) / -F.avg(F.when(F.col("r") < 0, F.col("r")))).alias("profit_loss"), F.max("r").alias("best"), F.min("r").alias("worst"),
        F.coalesce(F.max(F.when(F.col("r") > 0, F.col("len"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(F.col("r") < 0, F.col("len"))), F.lit(0)).alias("longest_loss"),
    )
    annual = F.pow(F.col("nav"), F.lit(365.0) / F.nullif(F.col("days"), F.lit(0))) - 1
    per_year = F.lit(float(periods_per_year)) if periods_per_year else F.col("n") / F.nullif(F.col("days"), F.lit(0)) * 365
    return out.select(
        "nav", annual.alias("annual"), F.when(F.col("std") > 0, F.col("m") / F.col("std") * F.sqrt(per_year)).alias("sharpe"), F.col("low.dd").alias("max_drawdown"), F.col("low.start").alias("drawdown_start"), F.col("low.d").alias("drawdown_end"),
        F.when(F.col("low.dd") < 0, annual / -F.col("low.dd")).alias("return_drawdown"), (F.lit(1) / (1 + F.col("low.dd")) - 1).alias("recovery_gain"), "win_rate", "win_rate_traded", "profit_loss", "best", "worst", "longest_win", "longest_loss", "std",
    )


def turnover_of_commission(commission: str, assets: str, rate: float, day: str = DAY) -> Column:
    """A period's turnover from what it paid in commission: the amount traded (commission / rate) over the assets before,
    or the period's own where there are none before; NULL for no assets or no rate."""
    if rate <= 0:
        return F.lit(None).cast("double")
    own = F.nullif(F.col(assets).cast("double"), F.lit(0.0))
    before = F.lag(own).over(Window.orderBy(day))  # a row a date
    return F.try_divide(F.col(commission).cast("double") / rate, F.coalesce(before, own))


def performance_report(curve: DataFrame, risk_free: float = 0.0, turnover: str | Column | None = None, day: str = DAY, ret: str = "ret") -> DataFrame:
    """One row for a series of period returns (a row a date): nav, annual (by calendar days), periods a year (rows / days *
    365), sharpe on the period's risk-free rate, mean and largest drawdown's recovery gain and the days that it takes at
    the annual return, winning and losing periods (0 counts as losing), mean return, profit over loss, longest runs, and
    the mean of the turnover column or expression, such as turnover_of_commission (NULL without one)."""
    traded = F.col(turnover) if isinstance(turnover, str) else F.lit(None) if turnover is None else turnover
    c = curve.select(F.col(day).alias("d"), F.col(ret).alias("r"), traded.cast("double").alias("t"))
    run = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("nav", F.exp(F.sum(F.log1p("r")).over(run)))
    c = c.withColumn("dd", F.col("nav") / F.max("nav").over(run) - 1).withColumn("win", F.col("r") > 0)
    c = c.withColumn("grp", F.row_number().over(Window.orderBy("d")) - F.row_number().over(Window.partitionBy("win").orderBy("d")))
    c = c.withColumn("len", F.count("*").over(Window.partitionBy("win", "grp")))
    one = lambda p: F.when(p, F.col("r"))
    a = c.agg(
        F.max_by("nav", "d").alias("nav"), F.datediff(F.max("d"), F.min("d")).alias("days"), F.count("r").alias("n"), F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("std"), F.min("dd").alias("max_drawdown"), F.avg(1 / (1 + F.col("dd")) - 1).alias("mean_gain"),
        F.sum(F.col("win").cast("long")).alias("wins"), F.sum((~F.col("win")).cast("long")).alias("losses"), (F.avg(one(F.col("win"))) / -F.avg(one(~F.col("win")))).alias("profit_loss"),
        F.coalesce(F.max(F.when(F.col("win"), F.col("len"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(~F.col("win"), F.col("len"))), F.lit(0)).alias("longest_loss"), F.avg("t").alias("turnover"),
    )
    a = a.withColumn("per_year", F.col("n") / F.nullif(F.col("days"), F.lit(0)) * 365).withColumn("annual", F.pow("nav", F.lit(365.0) / F.nullif(F.col("days"), F.lit(0))) - 1)
    free = F.pow(F.lit(1.0 + risk_free), 1 / F.col("per_year")) - 1
    a = a.withColumn("sharpe", F.when((F.col("n") > 1) & (F.col("std") > 0), (F.col("mean_return") - free) / F.col("std") * F.sqrt("per_year")))
    a = a.withColumn("max_gain", 1 / (1 + F.col("max_drawdown")) - 1)
    days_for = lambda g: F.log1p(g) / F.nullif(F.log1p("annual"), F.lit(0.0)) * 365
    return a.select("nav", "annual", "per_year", "sharpe", "max_drawdown", "mean_gain", "max_gain", days_for("mean_gain").alias("mean_recovery_days"), days_for("max_gain").alias("max_recovery_days"), "wins", "losses", "mean_return", "profit_loss", "longest_win", "longest_loss", "turnover")
