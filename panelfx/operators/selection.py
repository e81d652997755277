"""Selection, weights and rebalancing. Weights stay long: (strategy, select_date, code_id, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div, min_rank
from .joins import asof_join
from .staging import staged_entry  # noqa: F401

DAY, KEY = "trade_date", "code_id"


def rebalance_calendar(calendar: DataFrame, period: str, offset: int = 0) -> DataFrame:
    """period_id, select_date: the last trade date of each period. period: `W` (weeks), `2W`, `3W`, ... (that many weeks that
    have trade dates, from the offset-th on), `M` (months), or a number of trade days (from the offset-th day on). The
    calendar is a row a day."""
    days = calendar.select(DAY).distinct()
    if period in ("W", "M"):
        bucket = F.trunc(DAY, "week" if period == "W" else "month").cast("string")
    elif period.endswith("W"):
        week = F.dense_rank().over(Window.orderBy(F.trunc(DAY, "week"))) - 1
        bucket = F.floor((week - offset) / int(period[:-1])).cast("string")
    else:
        rn = F.row_number().over(Window.orderBy(DAY)) - 1
        bucket = F.floor((rn - offset) / int(period)).cast("string")
    return days.withColumn("period_id", F.concat(F.lit(f"{period}_{offset}:"), bucket)).groupBy("period_id").agg(F.max(DAY).alias("select_date"))


def select_topn(scored: DataFrame, n: float, score: str = "score") -> DataFrame:
    """Rows of the smallest scores of each date, equally weighted. n of 1 or more is a number; below 1 it is a share of
    all the date's rows (rows without score count). Ties at the edge are kept."""
    r = min_rank(score, DAY)
    limit = F.lit(float(n)) if int(n) else F.count(F.lit(1)).over(Window.partitionBy(DAY)) * n
    chosen = scored.withColumn("__r", r).withColumn("__l", limit).where(F.col("__r") <= F.col("__l"))
    return chosen.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(DAY))).drop("__r", "__l")


def post_filter(selected: DataFrame, condition) -> DataFrame:
    """Drops rows after selection without scaling the rest: what they held stays cash."""
    return selected.where(condition)


def timing_scope(scored: DataFrame, limit: float, score: str = "score") -> DataFrame:
    """The rows that feed a timing signal: the best `limit` of each date by score (a share below 1; all if not positive)."""
    if limit <= 0:
        return scored
    r = min_rank(score, DAY)
    share = r / F.count(score).over(Window.partitionBy(DAY))
    return scored.withColumn("__r", share if limit < 1 else r).where(F.col("__r") <= limit).drop("__r")


def timing_apply(weights: DataFrame, signal: DataFrame, fallback: float | None = None) -> DataFrame:
    """weights * timing by date; dates without a signal have 1, the last date `fallback` if that is given."""
    out = weights.join(F.broadcast(signal.select("select_date", F.col("signal").alias("timing"))), "select_date", "left").withColumn("timing", F.coalesce("timing", F.lit(1.0)))
    if fallback is not None:
        last = weights.agg(F.max("select_date").alias("__last"))
        out = out.join(F.broadcast(last), F.lit(True)).withColumn("timing", F.when(F.col("select_date") == F.col("__last"), F.lit(float(fallback))).otherwise(F.col("timing"))).drop("__last")
    return out.withColumn("weight", F.col("weight") * F.col("timing"))


def override_positions(weights: DataFrame, overrides: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Adds, for each override (strategy, select_date, signal), a copy of the strategy's latest selection on that date,
    its weights times the product of all signals since that selection. Dates that have a selection are skipped."""
    dates = weights.select(strategy, F.col("select_date").alias("base_date")).distinct()
    new = overrides.join(dates, (overrides["select_date"] == F.col("base_date")) & (overrides[strategy] == dates[strategy]), "left_anti")
    held = asof_join(new, dates, strategy, "select_date", "base_date", ["base_date"]).where("base_date is not null")
    w = Window.partitionBy(strategy, "base_date").orderBy("select_date").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("factor", F.product("signal").over(w))
    base = weights.withColumnRenamed("select_date", "base_date")
    copies = base.join(held.select(strategy, "base_date", F.col("select_date").alias("on"), "factor"), [strategy, "base_date"])
    copies = copies.withColumn("weight", F.col("weight") * F.col("factor")).withColumnRenamed("on", "select_date").select(*weights.columns)
    return weights.unionByName(copies)


def final_weight(selected: DataFrame, strategies: DataFrame) -> DataFrame:
    """weight * strategy weight * staged share (1 if there is none). Strategy weights are scaled to a sum of 1 only if they
    exceed it. strategies: strategy, strategy_weight (few rows, broadcast)."""
    total = strategies.agg(F.sum("strategy_weight").alias("__t"))
    scaled = strategies.join(total, F.lit(True)).withColumn("strategy_weight", F.col("strategy_weight") / F.greatest("__t", F.lit(1.0))).drop("__t")
    share = F.coalesce("share", F.lit(1.0)) if "share" in selected.columns else F.lit(1.0)
    return selected.join(F.broadcast(scaled), "strategy").withColumn("weight", F.col("weight") * F.col("strategy_weight") * share)


def union_strategies(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def latest_selection(weights: DataFrame) -> DataFrame:
    """Each strategy's rows of its last date."""
    return weights.withColumn("__m", F.max("select_date").over(Window.partitionBy("strategy"))).where("select_date = __m").drop("__m")


def weights_matrix(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """Long form of the date x code matrix: every rebalance date with every code of its strategy, absent ones 0."""
    codes = weights.select("strategy", KEY).distinct()
    grid = codes.join(F.broadcast(dates.select("select_date").distinct()), F.lit(True))
    return grid.join(weights.groupBy("strategy", "select_date", KEY).agg(F.sum("weight").alias("weight")), ["strategy", "select_date", KEY], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def weights_with_exits(weights: DataFrame, dates: DataFrame, by: tuple[str, ...] = ("strategy",), of: tuple[str, ...] = ()) -> DataFrame:
    """The date x code matrix without its zeros, but for those that sell: weights on rebalance dates (repeated rows summed),
    and 0 on the first rebalance date after a run of dates that a code is held on. Rows in proportion to the weights, where
    the whole matrix has codes x dates. dates: the columns `of` (a part of `by` that has calendars of its own, such as the
    period) and select_date; selections on other dates have no row."""
    order = dates.select(*of, "select_date").distinct()
    when = Window.partitionBy(*of, F.lit(0)).orderBy("select_date")  # a row a date of a calendar
    order = order.select(*of, "select_date", F.row_number().over(when).alias("__k"), F.lead("select_date").over(when).alias("__next"))
    held = weights.join(F.broadcast(order), [*of, "select_date"]).groupBy(*by, KEY, "select_date", "__k", "__next").agg(F.sum("weight").alias("weight"))
    last = F.coalesce(F.lead("__k").over(Window.partitionBy(*by, KEY).orderBy("__k")) != F.col("__k") + 1, F.lit(True))
    held = held.withColumn("__last", last)
    sold = F.when(F.col("__last") & F.col("__next").isNotNull(), F.struct(F.col("__next").alias("select_date"), F.lit(0.0).alias("weight")))
    rows = F.array_compact(F.array(F.struct("select_date", "weight"), sold))
    return held.select(*by, KEY, F.explode(rows).alias("r")).select(*by, KEY, "r.select_date", "r.weight")


def period_ratios(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """Target ratios by (strategy, period, time): every rebalance date of the period (dates: period, select_date) with every
    selected code, absent ones 0. weights: strategy, period, time, select_date, code_id, weight; selections on other dates
    have no row. Groups and dates are few and broadcast; what grows is the result."""
    by = ["strategy", "period", "time"]
    groups = weights.select(*by).distinct().join(dates.select("period", "select_date").distinct(), "period")
    grid = weights.select(KEY).distinct().join(F.broadcast(groups), F.lit(True))
    held = weights.groupBy(*by, "select_date", KEY).agg(F.sum("weight").alias("weight"))
    return grid.join(held, [*by, "select_date", KEY], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))


def period_weights(strategies: DataFrame) -> DataFrame:
    """Capital share of each period id: (strategy_weight, period, offsets array) spread evenly over the offsets."""
    each = strategies.select(F.col("strategy_weight") / F.size("offsets"), "period", F.explode("offsets").alias("offset")).toDF("w", "period", "offset")
    return each.groupBy(F.concat_ws("_", "period", "offset").alias("period_id")).agg(F.sum("w").alias("weight"))


def lot_round(targets: DataFrame, equity: float, price: str = "close", ratio: str = "weight", board: str = "board") -> DataFrame:
    """Adds shares: whole part of equity * 0.97 * ratio / price; 0 for no price or a value below 0.01; board 2 takes at
    least 200, others multiples of 100."""
    value = F.lit(equity * 0.97) * F.col(ratio)
    raw = F.floor(div(value, price))
    shares = F.when(F.col(price).isNull() | (value < 0.01) | (F.col(price) <= 0), 0).when(F.col(board) == 2, F.when(raw >= 200, raw).otherwise(0)).otherwise(F.floor(raw / 100) * 100)
    return targets.withColumn("shares", F.coalesce(shares, F.lit(0)).cast("long"))


def most_selected_by_year(weights: DataFrame, n: int) -> DataFrame:
    """year, codes: the codes selected most often (ties share a rank, of n at most), as `code:times` joined by spaces."""
    counts = weights.groupBy(F.year("select_date").alias("year"), KEY).agg(F.count("*").alias("times"))
    top = counts.withColumn("r", F.rank().over(Window.partitionBy("year").orderBy(F.desc("times")))).where(F.col("r") <= n)
    items = F.sort_array(F.collect_list(F.struct("r", KEY, "times")))
    return top.groupBy("year").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x[KEY].cast("string"), x["times"].cast("string"))), " ").alias("codes"))


def topm_buffer(ranked: DataFrame, n: int, multipliers: list[float], rank: str = "rank") -> DataFrame:
    """mult, date, code held: a code enters at rank <= n and stays while at rank <= m = ceil(n * mult). Between, the
    last event decides: enter (1), leave (0: rank over m, or absent); no fold is needed. ranked: (trade_date, code_id,
    rank) of every ranked row. A date without the code ends a run of its rows, and nothing is held over from run to run."""
    order = ranked.select(DAY).distinct().withColumn("__k", F.row_number().over(Window.orderBy(DAY)))  # a row a date
    own = Window.partitionBy(KEY).orderBy("__k")
    rows = ranked.select(DAY, KEY, rank).join(F.broadcast(order), DAY)
    rows = rows.withColumn("__gap", F.when(F.col("__k") - F.lag("__k").over(own) == 1, 0).otherwise(1)).withColumn("__run", F.sum("__gap").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    wide = rows.withColumn("mult", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])))
    event = F.when(F.col(rank) <= n, 1).when(F.col(rank).isNull() | (F.col(rank) > F.ceil(F.col("mult") * n)), 0)
    held = F.last(event, ignorenulls=True).over(Window.partitionBy("mult", KEY, "__run").orderBy("__k").rowsBetween(Window.unboundedPreceding, 0))
    return wide.withColumn("held", held).where("held = 1").select("mult", DAY, KEY, rank)


def buffer_report(held: DataFrame, returns: DataFrame, ret: str = "next_return") -> DataFrame:
    """For each multiplier: mean turnover (entering share of the holdings) and mean return, and both relative to the
    smallest multiplier's."""
    w = Window.partitionBy("mult", KEY).orderBy("__k")
    order = held.select(DAY).distinct().withColumn("__k", F.row_number().over(Window.orderBy(DAY)))
    marked = held.join(F.broadcast(order), DAY).withColumn("__new", F.when(F.lag("__k").over(w) == F.col("__k") - 1, 0.0).otherwise(1.0))
    by_date = marked.join(returns.select(DAY, KEY, ret), [DAY, KEY], "left").groupBy("mult", DAY).agg(F.avg("__new").alias("turnover"), F.avg(ret).alias("ret"))
    by = by_date.groupBy("mult").agg(F.avg("turnover").alias("turnover"), F.avg("ret").alias("ret"))
    first = by.agg(F.min_by(F.struct("turnover", "ret"), "mult").alias("b"))
    return by.join(F.broadcast(first), F.lit(True)).select("mult", "turnover", "ret", (1 - F.col("turnover") / F.col("b.turnover")).alias("turnover_cut"), (F.col("ret") / F.col("b.ret")).alias("return_kept"))
