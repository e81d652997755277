"""Hourly timing of selected codes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import STAMPS
from .joins import next_date_map


def signal_plan(selections: DataFrame, configs: DataFrame) -> DataFrame:
    """signal, codes (sorted distinct codes of all strategies that use it), n_strategies. configs: strategy, signal."""
    joined = selections.select("strategy", "code_id").distinct().join(F.broadcast(configs), "strategy")
    return joined.groupBy("signal").agg(F.sort_array(F.collect_set("code_id")).alias("codes"), F.count_distinct("strategy").alias("n_strategies"))


def hour_grid(calendar: DataFrame, stamps: tuple[str, ...] = STAMPS) -> DataFrame:
    """bar_ts of each stamp of each trade date."""
    days = calendar.select("trade_date").distinct()
    return days.withColumn("__s", F.explode(F.array(*map(F.lit, stamps)))).select("trade_date", F.to_timestamp_ntz(F.concat_ws(" ", F.col("trade_date").cast("string"), "__s")).alias("bar_ts"))


def effective_time(grid: DataFrame) -> DataFrame:
    """bar_ts, effective_ts: the next stamp of the calendar (a few thousand rows in all)."""
    return grid.select("bar_ts", F.lead("bar_ts").over(Window.orderBy("bar_ts")).alias("effective_ts"))


def session_time_shift(hhmm: Column, minutes: int) -> Column:
    """HHMM number shifted by minutes of trading: the break from 11:30 to 13:00 is skipped either way."""
    total = F.floor(hhmm / 100) * 60 + hhmm % 100
    session = F.when(total >= 780, total - 90).otherwise(F.least(total, F.lit(690))) + minutes
    clock = F.when(session > 690, session + 90).otherwise(session)
    return (F.floor(clock / 60) * 100 + clock % 60).cast("int")


def stock_signal(hours: DataFrame, signal: Callable[[Window], Column], key: str = "code_id", ts: str = "bar_ts", out: str = "signal") -> DataFrame:
    """Adds a user signal: an expression over the window of a code's bars in order."""
    return hours.withColumn(out, signal(Window.partitionBy(key).orderBy(ts)))


def signal_aggregate(signals: list[tuple[DataFrame, float]], keys: tuple[str, ...] = ("bar_ts", "code_id"), codes: DataFrame | None = None) -> DataFrame:
    """Sum over signals of weight * signal, for every key that any signal has; absent ones count 0. codes: a strategy's
    codes (code_id), others are left out before anything is summed."""
    if codes is not None:
        signals = [(s.join(codes.select("code_id").distinct(), "code_id", "left_semi"), w) for s, w in signals]
    parts = [s.select(*keys, (F.lit(w) * F.coalesce("signal", F.lit(0.0))).alias("signal")) for s, w in signals]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.sum("signal").alias("signal"))


def signal_wide(signals: DataFrame, codes: list[int]) -> DataFrame:
    """The aggregated signals as a table of bars by the given codes; 0 where a code has no signal."""
    return signals.groupBy("bar_ts").pivot("code_id", codes).agg(F.sum("signal")).na.fill(0.0)


def timing_weighted_sum(hours: DataFrame, weights: dict[str, float], out: str = "timing") -> DataFrame:
    """Sum of weight * signal over signal columns, NULL as 0."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * w
    return hours.withColumn(out, total)


def hourly_weights(weights: DataFrame, calendar: DataFrame, signals: DataFrame) -> DataFrame:
    """bar_ts, code_id, weight for every hour from the first selection on: a selection takes effect on the next trade
    date's first stamp and holds until the next one does; weights are multiplied by the code's signal of that hour
    (missing: 1); stamps are moved one hour back, to the bar's begin."""
    effect = next_date_map(weights.select(F.col("select_date").alias("d")).distinct(), calendar)
    grid = hour_grid(calendar)
    starts = effect.join(grid.groupBy("trade_date").agg(F.min("bar_ts").alias("__from")), F.col("next_date") == F.col("trade_date")).select(F.col("d").alias("select_date"), "__from")
    w = Window.orderBy("__from")
    spans = starts.groupBy("__from").agg(F.max("select_date").alias("select_date")).withColumn("__to", F.lead("__from").over(w))
    hours = grid.select("bar_ts").join(F.broadcast(spans), (F.col("bar_ts") >= F.col("__from")) & (F.col("__to").isNull() | (F.col("bar_ts") < F.col("__to"))))
    held = weights.groupBy("select_date", "code_id").agg(F.sum("weight").alias("weight"))
    out = held.join(hours, "select_date").join(signals.select("bar_ts", "code_id", "signal"), ["bar_ts", "code_id"], "left")
    return out.select((F.col("bar_ts") - F.expr("interval 1 hour")).alias("bar_ts"), "code_id", (F.col("weight") * F.coalesce("signal", F.lit(1.0))).alias("weight"))
