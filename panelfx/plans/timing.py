from pyspark.sql import functions as F

from ..functions import r6
from ..operators import timing as ops
from .registry import query, six
from .selection import _TWO, _W, _two, _weights

_TS = "%Y-%m-%d %H:%M:%S"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("signal_plan", f"SELECT g.signal, list_sort(list(DISTINCT code_id)) AS codes, count(DISTINCT t.strategy) AS n_strategies FROM {_TWO} t JOIN (VALUES ('a', 'ma'), ('b', 'ma'), ('b', 'vol')) g(strategy, signal) ON t.strategy = g.strategy GROUP BY g.signal")
def _(t):
    configs = t.spark.createDataFrame([("a", "ma"), ("b", "ma"), ("b", "vol")], "strategy string, signal string")
    return ops.signal_plan(_two(t), configs)


_GRID = "(SELECT trade_date, CAST(trade_date AS TIMESTAMP) + m * INTERVAL 1 MINUTE AS bar_ts FROM calendar CROSS JOIN (VALUES (630), (690), (840), (900)) s(m))"


@query("effective_time", f"SELECT strftime(bar_ts, '{_TS}') AS bar_ts, strftime(lead(bar_ts) OVER (ORDER BY bar_ts), '{_TS}') AS effective_ts FROM {_GRID}")
def _(t):
    out = ops.effective_time(ops.hour_grid(t.calendar))
    return out.select(_ts("bar_ts").alias("bar_ts"), _ts("effective_ts").alias("effective_ts"))


@query("session_time_shift", """WITH a AS (SELECT DISTINCT CAST(hour(ts) * 100 + minute(ts) AS INTEGER) AS hhmm FROM events WHERE hour(ts) BETWEEN 9 AND 10 OR hour(ts) BETWEEN 13 AND 14),
b AS (SELECT hhmm, hhmm // 100 * 60 + hhmm % 100 AS m FROM a), c AS (SELECT hhmm, CASE WHEN m >= 780 THEN m - 90 ELSE least(m, 690) END + 45 AS s FROM b), d AS (SELECT hhmm, CASE WHEN s > 690 THEN s + 90 ELSE s END AS k FROM c)
SELECT hhmm, CAST(k // 60 * 100 + k % 60 AS INTEGER) AS shifted FROM d""")
def _(t):
    hhmm = t.events.where("hour(ts) between 9 and 10 or hour(ts) between 13 and 14").select((F.hour("ts") * 100 + F.minute("ts")).cast("int").alias("hhmm")).distinct()
    return hhmm.withColumn("shifted", ops.session_time_shift(F.col("hhmm"), 45))


_SIGNAL = "(SELECT user_id AS code_id, bar_ts, CASE WHEN amount > avg(amount) OVER (PARTITION BY user_id ORDER BY bar_ts ROWS 2 PRECEDING) THEN 1.0 ELSE 0.5 END AS signal, n FROM hour_bars)"


def _signal(t):
    above = lambda w: F.when(F.col("amount") > F.avg("amount").over(w.rowsBetween(-2, 0)), 1.0).otherwise(0.5)
    return ops.stock_signal(t.hour_bars.withColumnRenamed("user_id", "code_id"), above)


@query("stock_signal", f"SELECT code_id, strftime(bar_ts, '{_TS}') AS bar_ts, signal FROM {_SIGNAL}")
def _(t):
    return _signal(t).select("code_id", _ts("bar_ts").alias("bar_ts"), "signal")


@query("signal_aggregate", f"SELECT code_id, strftime(bar_ts, '{_TS}') AS bar_ts, {six('sum(signal)')} AS signal FROM (SELECT code_id, bar_ts, 0.6 * signal AS signal FROM {_SIGNAL} WHERE n = 1 UNION ALL SELECT code_id, bar_ts, 0.4 * signal FROM {_SIGNAL} WHERE code_id % 2 = 0) GROUP BY 1, 2")
def _(t):
    s = _signal(t)
    out = ops.signal_aggregate([(s.where("n = 1"), 0.6), (s.where("code_id % 2 = 0"), 0.4)])
    return out.select("code_id", _ts("bar_ts").alias("bar_ts"), r6("signal").alias("signal"))


_OWN = f"(SELECT code_id, bar_ts, sum(signal) AS signal FROM (SELECT code_id, bar_ts, 0.6 * signal AS signal FROM {_SIGNAL} WHERE n = 1 UNION ALL SELECT code_id, bar_ts, 0.4 * signal FROM {_SIGNAL} WHERE code_id % 2 = 0) WHERE code_id IN (SELECT code_id FROM securities WHERE industry = 2) GROUP BY 1, 2)"


def _own(t):
    s = _signal(t)
    return ops.signal_aggregate([(s.where("n = 1"), 0.6), (s.where("code_id % 2 = 0"), 0.4)], codes=t.securities.where("industry = 2"))


@query("signal_aggregate_codes", f"SELECT code_id, strftime(bar_ts, '{_TS}') AS bar_ts, {six('signal')} AS signal FROM {_OWN}")
def _(t):
    return _own(t).select("code_id", _ts("bar_ts").alias("bar_ts"), r6("signal").alias("signal"))


@query("signal_wide", f"SELECT strftime(bar_ts, '{_TS}') AS bar_ts, " + ", ".join(six(f"coalesce(sum(signal) FILTER (code_id = {c}), 0)") + f' AS "{c}"' for c in (1, 2, 3, 4)) + f" FROM {_OWN} GROUP BY 1")
def _(t):
    out = ops.signal_wide(_own(t), [1, 2, 3, 4])
    return out.select(_ts("bar_ts").alias("bar_ts"), *(r6(str(c)).alias(str(c)) for c in (1, 2, 3, 4)))


@query("timing_weighted_sum", f"SELECT user_id, strftime(bar_ts, '{_TS}') AS bar_ts, {six('coalesce(CASE WHEN n > 1 THEN high END, 0) * 0.3 + low * 0.7')} AS timing FROM hour_bars")
def _(t):
    h = t.hour_bars.withColumn("a", F.when(F.col("n") > 1, F.col("high")))
    return ops.timing_weighted_sum(h, {"a": 0.3, "low": 0.7}).select("user_id", _ts("bar_ts").alias("bar_ts"), r6("timing").alias("timing"))


@query("hourly_weights", f"""WITH w AS (SELECT * FROM {_W}), e AS (SELECT d, coalesce((SELECT min(trade_date) FROM calendar WHERE trade_date > d), (SELECT max(trade_date) FROM calendar)) AS nd FROM (SELECT DISTINCT select_date AS d FROM w)),
s AS (SELECT max(d) AS select_date, CAST(nd AS TIMESTAMP) + INTERVAL 630 MINUTE AS f FROM e GROUP BY nd), p AS (SELECT *, lead(f) OVER (ORDER BY f) AS t FROM s),
g AS (SELECT code_id, bar_ts, CASE WHEN amount > 1000 THEN 0.5 ELSE 0.9 END AS signal FROM (SELECT b.code_id, x.bar_ts, b.amount FROM bars_d b JOIN {_GRID} x ON b.trade_date = x.trade_date))
SELECT w.code_id, strftime(x.bar_ts - INTERVAL 1 HOUR, '{_TS}') AS bar_ts, {six('w.weight * coalesce(g.signal, 1)')} AS weight FROM w JOIN p ON w.select_date = p.select_date JOIN {_GRID} x ON x.bar_ts >= p.f AND (p.t IS NULL OR x.bar_ts < p.t) LEFT JOIN g ON g.code_id = w.code_id AND g.bar_ts = x.bar_ts""")
def _(t):
    grid = ops.hour_grid(t.calendar)
    signals = t.bars_d.join(grid, "trade_date").select("code_id", "bar_ts", F.when(F.col("amount") > 1000, 0.5).otherwise(0.9).alias("signal"))
    return ops.hourly_weights(_weights(t), t.calendar, signals).select("code_id", _ts("bar_ts").alias("bar_ts"), r6("weight").alias("weight"))
