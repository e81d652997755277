"""As-of, ordered, interval, semi and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div


def asof_join(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, values: list[str], prefix: str = "", strict: bool = False, keep_time: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key whose right_on is at or before left_on (before
    it: strict). One exchange by key of the union of both sides; a running `last` does the rest. Of right rows at one
    time, the largest values win. keep_time names a column for the matched right_on."""
    time = keep_time or "__t"
    side = 1 if not strict else -1
    lhs = left.select("*", F.col(left_on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(right.select(F.struct(F.col(right_on).alias(time), *values)).schema[0].dataType).alias("__v"))
    rhs = right.where(F.col(right_on).isNotNull()).select(F.col(by), F.col(right_on).alias("__at"), F.lit(-side).alias("__side"), F.struct(F.col(right_on).alias(time), *values).alias("__v"))
    w = Window.partitionBy(by).orderBy("__at", "__side", F.col("__v")).rowsBetween(Window.unboundedPreceding, 0)
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn("__m", F.last("__v", ignorenulls=True).over(w))
    out = both.where("__side = 0")
    new = [F.col(f"__m.{v}").alias(f"{prefix}{v}") for v in values] + ([F.col(f"__m.{time}").alias(keep_time)] if keep_time else [])
    return out.select(*left.columns, *new)


def next_date_map(dates: DataFrame, calendar: DataFrame, date: str = "d", day: str = "trade_date") -> DataFrame:
    """Adds next_date: the first calendar day after each date; the last day where there is none. The distinct dates and
    the calendar (a row a day) are read once, backwards; the result goes back to the rows by a broadcast join."""
    asked = dates.select(F.col(date).alias("__d")).where("__d is not null").distinct().withColumn("__c", F.lit(None).cast(calendar.schema[day].dataType))
    both = asked.unionByName(calendar.select(F.col(day).alias("__d"), F.col(day).alias("__c")).distinct())
    later = Window.orderBy(F.desc("__d"), F.col("__c").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__n", F.last("__c", ignorenulls=True).over(later)).where("__c is null").select("__d", "__n")
    last = calendar.agg(F.max(day).alias("__last"))
    out = dates.join(F.broadcast(found), F.col(date) == F.col("__d"), "left").crossJoin(F.broadcast(last))
    return out.withColumn("next_date", F.coalesce("__n", "__last")).drop("__d", "__n", "__last")


def _daily_rate(bars: DataFrame, fx: DataFrame, day: str) -> DataFrame:
    """Bars with the latest rate at or before their day. Only distinct days are read in order, a few thousand rows; the
    result goes back to the bars by a broadcast join."""
    days = bars.select(F.col(day).alias("__d")).where("__d is not null").distinct().withColumn("__one", F.lit(1))
    known = fx.groupBy(F.col(day).alias("__r")).agg(F.max("rate").alias("rate")).withColumn("__one", F.lit(1))
    rates = asof_join(days, known, "__one", "__d", "__r", ["rate"]).drop("__one")
    return bars.join(F.broadcast(rates), F.col(day) == F.col("__d"), "left").drop("__d")


def ordered_merge_ffill(home: DataFrame, foreign: DataFrame, fx: DataFrame, by: str, day: str = "trade_date", stale_days: int = 10) -> DataFrame:
    """Home bars with the latest foreign close and exchange rate at or before the day, and foreign_adj = product. Codes
    whose latest foreign bar is more than stale_days older than their latest home bar get NULL."""
    fresh = foreign.groupBy(by).agg(F.max(day).alias("__f")).join(home.groupBy(by).agg(F.max(day).alias("__h")), by).where(F.datediff("__h", "__f") <= stale_days).select(by)
    out = asof_join(home, foreign.join(fresh, by, "left_semi"), by, day, day, ["foreign_close"])
    out = asof_join(out, fx, by, day, day, ["rate"]) if by in fx.columns else _daily_rate(out, fx, day)
    return out.withColumn("foreign_adj", F.col("foreign_close") * F.col("rate"))


def dividend_features(dividends: DataFrame, key: str = "code_id", report: str = "report_date", value: str = "dividend", price: str = "close") -> DataFrame:
    """For each dividend row: yield, and over the reports of the last 3 calendar years (open on the left) the mean, the
    sample deviation and the number of yields; and the run of consecutive years with a dividend."""
    months = F.year(report) * 12 + F.month(report)
    w = Window.partitionBy(key).orderBy("__m").rangeBetween(-35, 0)
    out = dividends.withColumn("yield", div(value, price)).withColumn("__m", months)
    out = out.withColumns({"yield_mean": F.avg("yield").over(w), "yield_std": F.stddev_samp("yield").over(w), "yield_n": F.count("yield").over(w)})
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy("__y"))
    out = out.withColumn("__y", F.year(report)).withColumn("__run", F.col("__y") - rank)
    first = F.min("__y").over(Window.partitionBy(key, "__run"))
    return out.withColumn("years", F.col("__y") - first + 1).drop("__m", "__y", "__run")


def bounded_ffill(panel: DataFrame, column: str, limit: int = 270, key: str = "code_id", day: str = "trade_date") -> DataFrame:
    """Carries a value forward over at most `limit` rows."""
    w = Window.partitionBy(key).orderBy(day)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = panel.withColumn("__rn", F.row_number().over(w))
    held = F.last(F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), F.col("__rn").alias("rn"))), ignorenulls=True).over(run)
    return out.withColumn("__h", held).withColumn(column, F.when(F.col("__rn") - F.col("__h.rn") <= limit, F.col("__h.v"))).drop("__h", "__rn")


def notice_rollup(notices: DataFrame, bars: DataFrame, key: str = "code_id", day: str = "trade_date") -> DataFrame:
    """Notices on the latest trade date at or before theirs: a row a (code, trade date) with their number and the titles,
    in order, joined by ==."""
    dated = asof_join(notices, bars.select(key, day), key, "notice_date", day, [day]).where(F.col(day).isNotNull())
    items = F.sort_array(F.collect_list(F.struct("notice_date", "title")))
    return dated.groupBy(key, day).agg(F.count("*").alias("n_notices"), F.array_join(F.transform(items, lambda x: x["title"]), "==").alias("titles"))


def factor_attach(base: DataFrame, *tables: DataFrame, on: tuple[str, ...] = ("trade_date", "code_id")) -> DataFrame:
    """Base rows with each table's columns, by key; missing ones are NULL."""
    for t in tables:
        base = base.join(t, list(on), "left")
    return base


def semi_filter(panel: DataFrame, keep: DataFrame, on: str | list[str]) -> DataFrame:
    return panel.join(keep, on, "left_semi")


def anti_missing_periods(expected: DataFrame, filings: DataFrame, on: list[str]) -> DataFrame:
    """Expected (code, period) rows without a filing."""
    return expected.join(filings, on, "left_anti")


def interval_window_join(panel: DataFrame, windows: DataFrame, day: str = "trade_date") -> DataFrame:
    """Each row with each window (few rows, broadcast) that holds its day: half-open [train_start, val_start),
    [val_start, test_start), [test_start, test_end), and the part's name."""
    d = F.col(day)
    part = F.when(d < F.col("val_start"), "train").when(d < F.col("test_start"), "val").otherwise("test")
    return panel.join(F.broadcast(windows), (d >= F.col("train_start")) & (d < F.col("test_end"))).withColumn("part", part)


