"""Bar cleaning, adjustment and densification. Panels are keyed by (code_id, trade_date)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cumprod, div, ffill

KEY, DAY = "code_id", "trade_date"


def history(key: str = KEY, day: str = DAY):
    return Window.partitionBy(key).orderBy(day)


def bar_basics(bars: DataFrame) -> DataFrame:
    """Adds pct_change, turnover, avg_price, listed_days. Needs close, pre_close, amount, volume, float_mv."""
    return bars.withColumns({
        "pct_change": div("close", "pre_close") - 1,
        "turnover": div("amount", "float_mv"),
        "avg_price": div("amount", "volume"),
        "listed_days": F.dense_rank().over(history()),
    })


def adjust_prices(bars: DataFrame, forward: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Adds adj_close, and adj_x for open, high, low and extra prices: close follows the running product of
    close / pre_close, scaled to the first close of a code (backward) or to its last (forward)."""
    whole = history().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.last if forward else F.first
    out = bars.withColumn("__f", cumprod(div("close", "pre_close"), KEY, DAY))
    out = out.withColumn("adj_close", F.col("__f") * pick("close").over(whole) / pick("__f").over(whole))
    return out.withColumns({f"adj_{p}": div(p, "close") * F.col("adj_close") for p in ("open", "high", "low", *extra)}).drop("__f")


def _half_up(x: Column) -> Column:
    return F.floor((x + 1e-7) * 100 + 0.5) / 100


def price_limits(bars: DataFrame) -> DataFrame:
    """Adds up_limit and down_limit from pre_close by board (code) and risk mark (name). 10 % in general, 5 % under a risk
    mark; 20 % on sh68, and on sz3 after 2020-08-23; 30 % on bj, whose limits round inwards. Later rules win."""
    p, code = F.col("pre_close"), F.col("code")
    wide = code.startswith("sh68") | (code.startswith("sz3") & (F.col(DAY) > F.lit("2020-08-23").cast("date")))
    rate = F.when(wide, 0.2).when(F.col("name").contains("ST"), 0.05).otherwise(0.1)
    bj = code.startswith("bj")
    return bars.withColumns({
        "up_limit": F.when(bj, F.floor((p * 1.3 + 1e-7) * 100) / 100).otherwise(_half_up(p * (1 + rate))),
        "down_limit": F.when(bj, F.ceil((p * 0.7 - 1e-7) * 100) / 100).otherwise(_half_up(p * (1 - rate))),
    })


def limit_flags(bars: DataFrame) -> DataFrame:
    """Adds one_price_up/down, open_up/down_limit and touch_up/down. Needs open, high, low and the limits."""
    return bars.withColumns({
        "one_price_up": F.col("low") >= F.col("up_limit"),
        "one_price_down": F.col("high") <= F.col("down_limit"),
        "open_up_limit": F.col("open") >= F.col("up_limit"),
        "open_down_limit": F.col("open") <= F.col("down_limit"),
        "touch_up": F.col("high") >= F.col("up_limit"),
        "touch_down": F.col("low") <= F.col("down_limit"),
    })


def classify_board(code: Column) -> Column:
    """Board id of a code by its prefix: bj 0, sh60 1, sh68 2, sz0 3, other sz 4; NULL for any other."""
    return F.when(code.startswith("bj"), 0).when(code.startswith("sh60"), 1).when(code.startswith("sh68"), 2).when(code.startswith("sz0"), 3).when(code.startswith("sz"), 4)


def run_length_panel(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """bars on calendar dates, each with __k (its place in the calendar, from 0), __until (the place of the code's next bar;
    the calendar's length for its last one), close carried on over missing ones, and __before (the close carried to the
    bar). A bar stands for the days up to the next one: halted days have no rows. The calendar (a row a day) is broadcast."""
    days = calendar.select(F.col(DAY)).distinct()
    order = days.select(DAY, (F.row_number().over(Window.orderBy(DAY)) - 1).alias("__k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("__n"))
    rows = bars.join(F.broadcast(order), DAY)
    w = Window.partitionBy(KEY).orderBy("__k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("close", F.last("close", ignorenulls=True).over(upto))
    rows = rows.withColumns({"__until": F.coalesce(F.lead("__k").over(w), "__n"), "__before": F.lag("close").over(w)})
    return rows.drop("__n").select(*bars.columns, "__k", "__until", "__before")


def expand_days(panel: DataFrame, calendar: DataFrame, flows: tuple[str, ...] = ("volume", "amount"), days: DataFrame | None = None) -> DataFrame:
    """The days of a run-length panel as rows, or only the days asked for (trade_date). On halted days close is carried on,
    open, high, low and pre_close are that close, flows are 0, is_trade is 0 and everything else NULL."""
    order = calendar.select(F.col(DAY).alias("__day")).distinct()
    order = order.select("__day", (F.row_number().over(Window.orderBy("__day")) - 1).alias("__at"))
    if days is None:
        rows = panel.withColumn("__at", F.explode(F.sequence("__k", F.greatest("__k", F.col("__until") - 1))))
        rows = rows.join(F.broadcast(order), "__at")
    else:
        asked = order.join(days.select(F.col(DAY).alias("__day")).distinct(), "__day", "left_semi")
        inside = (F.col("__at") >= F.col("__k")) & (F.col("__at") < F.greatest(F.col("__until"), F.col("__k") + 1))
        rows = panel.join(F.broadcast(asked), inside)
    own = F.col("__at") == F.col("__k")

    def value(c: str) -> Column:
        if c in ("open", "high", "low"):
            return F.when(own, F.coalesce(c, "close")).otherwise(F.col("close"))
        if c == "pre_close":
            return F.when(own, F.coalesce(c, "__before")).otherwise(F.col("close"))
        if c in flows:
            return F.when(own, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
        return F.col(c) if c in (KEY, "close") else F.when(own, F.col(c))

    rest = [c for c in panel.columns if c not in (KEY, DAY, "__k", "__until", "__before")]
    return rows.select(KEY, F.col("__day").alias(DAY), *(value(c).alias(c) for c in rest), own.cast("int").alias("is_trade"))


def densify_calendar(bars: DataFrame, calendar: DataFrame, flows: tuple[str, ...] = ("volume", "amount"), days: DataFrame | None = None) -> DataFrame:
    """A row for each calendar date from a code's first bar on a calendar date on, or for the dates of `days` only. On added
    days close is carried on, open, high, low and pre_close are that close, flows are 0 and is_trade is 0. Windows run over
    the bars, not over the days added: those come from the run-length panel by one explode."""
    return expand_days(run_length_panel(bars, calendar), calendar, flows, days)


def membership_fill(panel: DataFrame, column: str) -> DataFrame:
    """Y/N membership: carried forward on halted rows (is_trade 0) only; whatever is still missing is N."""
    return panel.withColumn(column, F.coalesce(F.when(F.col("is_trade") == 0, ffill(column, KEY, DAY)).otherwise(F.col(column)), F.lit("N")))


def membership_days(bars: DataFrame, calendar: DataFrame, column: str) -> DataFrame:
    """code_id, trade_date, is_trade, column: membership_fill of the calendar's days. What a halted day carries is known at the
    bar before it, so the window runs over bars; the days come after it and are neither sorted nor held."""
    known = F.last(column, ignorenulls=True).over(history().rowsBetween(Window.unboundedPreceding, 0))
    rows = run_length_panel(bars.select(KEY, DAY, "close", column), calendar).withColumn("__held", known)
    order = calendar.select(F.col(DAY).alias("__day")).distinct().select("__day", (F.row_number().over(Window.orderBy("__day")) - 1).alias("__at"))
    out = rows.withColumn("__at", F.explode(F.sequence("__k", F.greatest("__k", F.col("__until") - 1)))).join(F.broadcast(order), "__at")
    own = F.col("__at") == F.col("__k")
    value = F.coalesce(F.when(own, F.col(column)).otherwise(F.col("__held")), F.lit("N"))
    return out.select(KEY, F.col("__day").alias(DAY), own.cast("int").alias("is_trade"), value.alias(column))


def trim_delisted(panel: DataFrame, mark: str = "退") -> DataFrame:
    """Drops what follows the last row whose name has the delisting mark; codes without the mark stay whole."""
    last = F.max(F.when(F.col("name").contains(mark), F.col(DAY))).over(Window.partitionBy(KEY))
    return panel.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(DAY) <= F.col("__last"))).drop("__last")


def ffill_columns(panel: DataFrame, columns: list[str]) -> DataFrame:
    return panel.withColumns({c: ffill(c, KEY, DAY) for c in columns})


def next_day_state(panel: DataFrame, states: tuple[str, ...] = ("is_trade", "is_st", "is_s", "is_delist"), limits: tuple[str, ...] = ("one_price_up", "open_up_limit", "open_down_limit")) -> DataFrame:
    """Adds next_x. A code's last bar reuses the state of the bar before for states; limits stay NULL there."""
    w = history()
    last = F.lead(F.lit(1)).over(w).isNull()
    cols = {f"next_{c}": F.when(last, F.lag(c).over(w)).otherwise(F.lead(c).over(w)) for c in states}
    return panel.withColumns(cols | {f"next_{c}": F.lead(c).over(w) for c in limits})


def minute_price_join(panel: DataFrame, minutes: DataFrame) -> DataFrame:
    """Adds the minute closes (columns but the keys); where missing, as on halted days, the day's close."""
    cols = [c for c in minutes.columns if c not in (KEY, DAY)]
    return panel.join(minutes, [KEY, DAY], "left").withColumns({c: F.coalesce(c, "close") for c in cols})


STAMPS = ("10:30:00", "11:30:00", "14:00:00", "15:00:00")


def daily_to_hourly(panel: DataFrame, values: list[str], stamps: tuple[str, ...] = STAMPS, backfill: bool = False) -> DataFrame:
    """Four stamps a day; the day's values stand on the last one, the others are NULL (or the next value: backfill)."""
    out = panel.withColumn("__s", F.explode(F.array(*map(F.lit, stamps))))
    out = out.withColumn("bar_ts", F.to_timestamp_ntz(F.concat_ws(" ", F.col(DAY).cast("string"), "__s"))).withColumns({v: F.when(F.col("__s") == stamps[-1], F.col(v)) for v in values}).drop("__s")
    if backfill:
        ahead = Window.partitionBy(KEY).orderBy("bar_ts").rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumns({v: F.first(v, ignorenulls=True).over(ahead) for v in values})
    return out


def market_pivot(panel: DataFrame, field: str, codes: list) -> DataFrame:
    """A row a day and a column for each of the listed codes."""
    return panel.groupBy(DAY).pivot(KEY, codes).agg(F.first(field))


def date_cut(panel: DataFrame, start=None, end=None) -> DataFrame:
    """Rows from start to end, both kept; to be used after factors, so that look-backs are whole."""
    tests = [F.col(DAY) >= F.lit(start).cast("date")] * (start is not None) + [F.col(DAY) <= F.lit(end).cast("date")] * (end is not None)
    return panel.where(reduce(Column.__and__, tests)) if tests else panel


def exclude_boards(panel: DataFrame, prefixes: list[str]) -> DataFrame:
    """Without the codes that begin with one of the prefixes; `kcb` means sh68, `cyb` sz30."""
    names = {"kcb": "sh68", "cyb": "sz30"}
    for p in prefixes:
        panel = panel.where(~F.col("code").startswith(names.get(p, p)))
    return panel
