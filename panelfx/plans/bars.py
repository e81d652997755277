from pyspark.sql import functions as F

from ..functions import r4, r6
from ..operators import bars as ops
from .registry import query, six

_MV = "(SELECT b.*, s.code, s.name, b.close * s.float_shares AS float_mv FROM bars_d b JOIN securities s ON b.code_id = s.code_id)"


def _panel(t):
    return t.bars_d.join(t.securities, "code_id").withColumn("float_mv", F.col("close") * F.col("float_shares"))


@query("bar_basics", f"SELECT code_id, trade_date, {six('close / nullif(pre_close, 0) - 1')} AS pct_change, {six('amount / nullif(float_mv, 0)')} AS turnover, {six('amount / nullif(volume, 0)', 4)} AS avg_price, dense_rank() OVER (PARTITION BY code_id ORDER BY trade_date) AS listed_days FROM {_MV}")
def _(t):
    out = ops.bar_basics(_panel(t))
    return out.select("code_id", "trade_date", r6("pct_change").alias("pct_change"), r6("turnover").alias("turnover"), r4("avg_price").alias("avg_price"), "listed_days")


_ADJ = """WITH f AS (SELECT *, exp(sum(ln(close / nullif(pre_close, 0))) OVER (PARTITION BY code_id ORDER BY trade_date)) AS f FROM bars_d),
a AS (SELECT *, f * first(close) OVER w / first(f) OVER w AS adj_close FROM f WINDOW w AS (PARTITION BY code_id ORDER BY trade_date{desc} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT code_id, trade_date, {c} AS adj_close, {o} AS adj_open, {h} AS adj_high, {l} AS adj_low FROM a"""


def _adj(desc):
    return _ADJ.format(desc=desc, c=six("adj_close", 4), o=six("open / close * adj_close", 4), h=six("high / close * adj_close", 4), l=six("low / close * adj_close", 4))


@query("adjust_prices", _adj(""))
def _(t):
    return ops.adjust_prices(t.bars_d).select("code_id", "trade_date", *(r4(c).alias(c) for c in ("adj_close", "adj_open", "adj_high", "adj_low")))


@query("adjust_prices_forward", _adj(" DESC"))
def _(t):
    return ops.adjust_prices(t.bars_d, forward=True).select("code_id", "trade_date", *(r4(c).alias(c) for c in ("adj_close", "adj_open", "adj_high", "adj_low")))


_LIMITS = """(SELECT *, CASE WHEN code LIKE 'bj%' THEN floor((pre_close * 1.3 + 1e-7) * 100) / 100 ELSE floor((pre_close * (1 + rate) + 1e-7) * 100 + 0.5) / 100 END AS up_limit,
 CASE WHEN code LIKE 'bj%' THEN ceil((pre_close * 0.7 - 1e-7) * 100) / 100 ELSE floor((pre_close * (1 - rate) + 1e-7) * 100 + 0.5) / 100 END AS down_limit
 FROM (SELECT *, CAST(CASE WHEN code LIKE 'sh68%' OR (code LIKE 'sz3%' AND trade_date > DATE '2020-08-23') THEN 0.2 WHEN name LIKE '%ST%' THEN 0.05 ELSE 0.1 END AS DOUBLE) AS rate FROM """ + _MV + "))"


@query("price_limits", f"SELECT code_id, trade_date, up_limit, down_limit FROM {_LIMITS}")
def _(t):
    return ops.price_limits(_panel(t)).select("code_id", "trade_date", "up_limit", "down_limit")


@query("limit_flags", f"SELECT code_id, trade_date, low >= up_limit AS one_price_up, high <= down_limit AS one_price_down, open >= up_limit AS open_up_limit, open <= down_limit AS open_down_limit, high >= up_limit AS touch_up, low <= down_limit AS touch_down FROM {_LIMITS}")
def _(t):
    flags = ["one_price_up", "one_price_down", "open_up_limit", "open_down_limit", "touch_up", "touch_down"]
    return ops.limit_flags(ops.price_limits(_panel(t))).select("code_id", "trade_date", *flags)


@query("classify_board", "SELECT code, CASE WHEN code LIKE 'bj%' THEN 0 WHEN code LIKE 'sh60%' THEN 1 WHEN code LIKE 'sh68%' THEN 2 WHEN code LIKE 'sz0%' THEN 3 WHEN code LIKE 'sz%' THEN 4 END AS board FROM securities")
def _(t):
    return t.securities.select("code", ops.classify_board(F.col("code")).alias("board"))


_DENSE = """(SELECT g.code_id, g.trade_date, coalesce(b.is_trade, 0) AS is_trade, b.open AS o, b.high AS h, b.low AS l, b.pre_close AS p, b.volume AS v, b.amount AS a,
 last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.code_id ORDER BY g.trade_date) AS close
 FROM (SELECT code_id, c.trade_date FROM (SELECT code_id, min(trade_date) AS f FROM bars_d GROUP BY code_id) s JOIN calendar c ON c.trade_date >= s.f) g
 LEFT JOIN (SELECT *, 1 AS is_trade FROM bars_d) b ON g.code_id = b.code_id AND g.trade_date = b.trade_date)"""


@query("densify_calendar", f"SELECT code_id, trade_date, is_trade, close, coalesce(o, close) AS open, coalesce(h, close) AS high, coalesce(l, close) AS low, coalesce(p, lag(close) OVER (PARTITION BY code_id ORDER BY trade_date)) AS pre_close, coalesce(v, 0) AS volume, coalesce(a, 0) AS amount FROM {_DENSE}")
def _(t):
    return ops.densify_calendar(t.bars_d, t.calendar).select("code_id", "trade_date", "is_trade", "close", "open", "high", "low", "pre_close", "volume", "amount")


@query("membership_fill", f"""SELECT code_id, trade_date, coalesce(CASE WHEN is_trade = 0 THEN last_value(m IGNORE NULLS) OVER (PARTITION BY code_id ORDER BY trade_date) ELSE m END, 'N') AS member
FROM (SELECT code_id, trade_date, is_trade, CASE WHEN v > 30 THEN 'Y' WHEN v > 15 THEN 'N' END AS m FROM {_DENSE})""")
def _(t):
    marked = t.bars_d.withColumn("member", F.when(F.col("volume") > 30, "Y").when(F.col("volume") > 15, "N"))
    return ops.membership_days(marked, t.calendar, "member").select("code_id", "trade_date", "member")


_MARKED = "(SELECT b.code_id, b.trade_date, CASE WHEN s.name LIKE '%退%' AND b.trade_date > DATE '1996-12-31' THEN substr(s.name, 3) ELSE s.name END AS name FROM bars_m b JOIN securities s ON b.code_id = s.code_id)"


@query("trim_delisted", f"SELECT code_id, trade_date, name FROM (SELECT *, max(CASE WHEN name LIKE '%退%' THEN trade_date END) OVER (PARTITION BY code_id) AS m FROM {_MARKED}) WHERE m IS NULL OR trade_date <= m")
def _(t):
    late = F.col("name").contains("退") & (F.col("trade_date") > F.lit("1996-12-31").cast("date"))
    named = t.bars_m.join(t.securities, "code_id").withColumn("name", F.when(late, F.substring("name", 3, 100)).otherwise(F.col("name")))
    return ops.trim_delisted(named).select("code_id", "trade_date", "name")


@query("ffill_columns", f"SELECT code_id, trade_date, last_value(v IGNORE NULLS) OVER w AS volume, last_value(a IGNORE NULLS) OVER w AS amount FROM {_DENSE} WINDOW w AS (PARTITION BY code_id ORDER BY trade_date)")
def _(t):
    dense = ops.densify_calendar(t.bars_d, t.calendar, flows=())
    return ops.ffill_columns(dense, ["volume", "amount"]).select("code_id", "trade_date", "volume", "amount")


@query("next_day_state", f"""SELECT code_id, trade_date, CASE WHEN lead(1) OVER w IS NULL THEN lag(is_st) OVER w ELSE lead(is_st) OVER w END AS next_is_st,
 CASE WHEN lead(1) OVER w IS NULL THEN lag(big) OVER w ELSE lead(big) OVER w END AS next_big, lead(up) OVER w AS next_up
 FROM (SELECT code_id, trade_date, name LIKE '%ST%' AND volume > 20 AS is_st, volume > 30 AS big, low >= up_limit AS up FROM {_LIMITS}) WINDOW w AS (PARTITION BY code_id ORDER BY trade_date)""")
def _(t):
    flagged = ops.price_limits(_panel(t)).withColumns({"is_st": F.col("name").contains("ST") & (F.col("volume") > 20), "big": F.col("volume") > 30, "up": F.col("low") >= F.col("up_limit")})
    return ops.next_day_state(flagged, ("is_st", "big"), ("up",)).select("code_id", "trade_date", "next_is_st", "next_big", "next_up")


@query("minute_price_join", f"""SELECT d.code_id, d.trade_date, coalesce(m.c1000, d.close) AS c1000, coalesce(m.c1430, d.close) AS c1430
FROM (SELECT code_id, trade_date, close FROM {_DENSE}) d LEFT JOIN (SELECT code_id, trade_date, floor((open + low) / 2 * 100 + 0.5) / 100 AS c1000, high AS c1430 FROM bars_d) m ON d.code_id = m.code_id AND d.trade_date = m.trade_date""")
def _(t):
    dense = ops.densify_calendar(t.bars_d, t.calendar).select("code_id", "trade_date", "close")
    minutes = t.bars_d.select("code_id", "trade_date", (F.floor((F.col("open") + F.col("low")) / 2 * 100 + 0.5) / 100).alias("c1000"), F.col("high").alias("c1430"))
    return ops.minute_price_join(dense, minutes).select("code_id", "trade_date", "c1000", "c1430")


_HOURS = """(SELECT code_id, trade_date, CAST(trade_date AS TIMESTAMP) + s.m * INTERVAL 1 MINUTE AS bar_ts, CASE WHEN s.m = 900 THEN close END AS close, CASE WHEN s.m = 900 THEN volume END AS volume
FROM bars_m CROSS JOIN (VALUES (630), (690), (840), (900)) s(m))"""


@query("daily_to_hourly", f"SELECT code_id, trade_date, strftime(bar_ts, '%Y-%m-%d %H:%M:%S') AS bar_ts, close, volume FROM {_HOURS}")
def _(t):
    return ops.daily_to_hourly(t.bars_m, ["close", "volume"]).select("code_id", "trade_date", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("bar_ts"), "close", "volume")


@query("daily_to_hourly_backfill", f"SELECT code_id, trade_date, strftime(bar_ts, '%Y-%m-%d %H:%M:%S') AS bar_ts, first_value(close IGNORE NULLS) OVER (PARTITION BY code_id ORDER BY bar_ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM {_HOURS}")
def _(t):
    return ops.daily_to_hourly(t.bars_m, ["close"], backfill=True).select("code_id", "trade_date", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss").alias("bar_ts"), "close")


@query("market_pivot", "SELECT trade_date, max(CASE WHEN code_id = 1 THEN close END) AS c1, max(CASE WHEN code_id = 2 THEN close END) AS c2, max(CASE WHEN code_id = 3 THEN close END) AS c3 FROM bars_m GROUP BY trade_date")
def _(t):
    return ops.market_pivot(t.bars_m, "close", [1, 2, 3]).toDF("trade_date", "c1", "c2", "c3")


@query("date_cut", f"SELECT code_id, trade_date, {six('c3')} AS mean3 FROM (SELECT code_id, trade_date, avg(close) OVER (PARTITION BY code_id ORDER BY trade_date ROWS 2 PRECEDING) AS c3 FROM bars_m) WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def _(t):
    w = ops.history().rowsBetween(-2, 0)
    return ops.date_cut(t.bars_m.withColumn("mean3", r6(F.avg("close").over(w))), "1995-01-01", "1996-06-30").select("code_id", "trade_date", "mean3")


@query("exclude_boards", "SELECT b.code_id, trade_date, code, close FROM bars_m b JOIN securities s ON b.code_id = s.code_id WHERE NOT (code LIKE 'sh68%' OR code LIKE 'bj%')")
def _(t):
    return ops.exclude_boards(t.bars_m.join(t.securities, "code_id"), ["kcb", "bj"]).select("code_id", "trade_date", "code", "close")
