from pyspark.sql import functions as F

from ..functions import r2, r4, r6
from ..operators import bars as bar_ops
from ..operators import portfolio as ops
from .bars import _LIMITS
from .registry import query, six
from .selection import _SCORE, _W, _scored, _weights

_RET = "(SELECT trade_date, code_id, close / pre_close - 1 AS ret FROM bars_m)"
_SPAN = "(SELECT DISTINCT trade_date FROM bars_m)"
# selections of every date
_WH = _W


def _wh(t):
    return _weights(t)


def _ret(t):
    return t.bars_m.select("trade_date", "code_id", (F.col("close") / F.col("pre_close") - 1).alias("ret"))


_PR = f"""(WITH w AS {_WH}, s AS (SELECT DISTINCT select_date FROM w), d AS (SELECT x.trade_date, s.select_date FROM {_SPAN} x ASOF JOIN s ON x.trade_date >= s.select_date)
SELECT d.trade_date, sum(w.weight * coalesce(r.ret, 0)) AS ret FROM d JOIN w ON w.select_date = d.select_date LEFT JOIN {_RET} r ON r.trade_date = d.trade_date AND r.code_id = w.code_id GROUP BY d.trade_date)"""


@query("portfolio_returns", f"SELECT trade_date, {six('ret')} AS ret FROM {_PR}")
def _(t):
    return ops.portfolio_returns(_wh(t), _ret(t)).select("trade_date", r6("ret").alias("ret"))


@query("execution_price", f"SELECT code_id, trade_date, close AS sell, lead(open) OVER w AS buy, {six('lead(close) OVER w / lead(open) OVER w - 1')} AS ret FROM bars_m WINDOW w AS (PARTITION BY code_id ORDER BY trade_date)")
def _(t):
    return ops.holding_return(t.bars_m, "close-open").select("code_id", "trade_date", "sell", "buy", r6("ret").alias("ret"))


@query("execution_price_minutes", "SELECT code_id, trade_date, lead(low) OVER w AS sell, lead(high) OVER w AS buy FROM bars_m WINDOW w AS (PARTITION BY code_id ORDER BY trade_date)")
def _(t):
    return ops.holding_return(t.bars_m.withColumns({"c0935": F.col("low"), "c0955": F.col("high")}), "0935-0955").select("code_id", "trade_date", "sell", "buy")


_COST = f"""(WITH w AS {_WH}, o AS (SELECT select_date, lead(select_date) OVER (ORDER BY select_date) AS n FROM (SELECT DISTINCT select_date FROM w)),
d AS (SELECT select_date, code_id, sum(d) AS d FROM (SELECT select_date, code_id, weight AS d FROM w UNION ALL SELECT n, code_id, -weight FROM w JOIN o USING (select_date) WHERE n IS NOT NULL) GROUP BY 1, 2)
SELECT select_date, sum(greatest(d, 0)) AS buy, sum(greatest(-d, 0)) AS sell FROM d GROUP BY 1)"""


@query("turnover_cost", f"SELECT select_date, {six('buy')} AS buy, {six('sell')} AS sell, {six('(buy + sell) * 0.00012 + sell * 0.001')} AS cost FROM {_COST}")
def _(t):
    return ops.turnover_cost(_wh(t)).select("select_date", *(r6(c).alias(c) for c in ("buy", "sell", "cost")))


@query("net_returns", f"SELECT p.trade_date, {six('ret')} AS gross, {six('ret - coalesce((buy + sell) * 0.00012 + sell * 0.001, 0)')} AS net FROM {_PR} p LEFT JOIN {_COST} c ON p.trade_date = c.select_date")
def _(t):
    out = ops.net_returns(ops.portfolio_returns(_wh(t), _ret(t)), ops.turnover_cost(_wh(t)))
    return out.select("trade_date", r6("gross").alias("gross"), r6("net").alias("net"))


@query("limit_down_carry", f"WITH l AS (SELECT code_id, trade_date FROM {_LIMITS} WHERE close > down_limit), e AS (SELECT code_id, trade_date AS planned FROM bars_m) SELECT e.code_id, e.planned, l.trade_date AS exit_date FROM e ASOF LEFT JOIN l ON e.code_id = l.code_id AND e.planned <= l.trade_date")
def _(t):
    limited = bar_ops.price_limits(t.bars_d.join(t.securities, "code_id"))
    return ops.limit_down_carry(t.bars_m.select("code_id", F.col("trade_date").alias("planned")), limited)


_ACC = "(SELECT code_id, trade_date, amount AS cash, volume * close AS position_value, amount * 0.001 AS commission, volume * 0.01 AS tax FROM bars_m)"


@query("account_series", f"SELECT code_id, trade_date, {six('total', 2)} AS total, {six('total / 100000', 4)} AS nav, {six('commission + tax', 2)} AS fee, {six('total / lag(total, 1, 100000) OVER (PARTITION BY code_id ORDER BY trade_date) - 1')} AS pct_change, {six('position_value / total')} AS leverage FROM (SELECT *, cash + position_value AS total FROM {_ACC})")
def _(t):
    acc = t.bars_m.select("code_id", "trade_date", F.col("amount").alias("cash"), (F.col("volume") * F.col("close")).alias("position_value"), (F.col("amount") * 0.001).alias("commission"), (F.col("volume") * 0.01).alias("tax"))
    out = ops.account_series(acc, 100000.0, ["code_id"])
    return out.select("code_id", "trade_date", r2("total").alias("total"), r4("nav").alias("nav"), r2("fee").alias("fee"), r6("pct_change").alias("pct_change"), r6("leverage").alias("leverage"))


_TAME = "greatest(least((ret - 4.6) / 40, 0.2), -0.2)"
_BENCH = "(SELECT trade_date, greatest(least((avg(close / pre_close) - 5) / 40, 0.2), -0.2) AS b FROM bars_m GROUP BY trade_date)"
_CURVE = f"(SELECT p.trade_date, exp(sum(ln(1 + {_TAME})) OVER w) AS nav, exp(sum(ln(1 + coalesce(b, 0))) OVER w) AS bench FROM {_PR} p LEFT JOIN {_BENCH} x ON p.trade_date = x.trade_date WINDOW w AS (ORDER BY p.trade_date))"


def _curve(t):
    r = ops.portfolio_returns(_wh(t), _ret(t)).withColumn("ret", F.expr(_TAME))
    bench = t.bars_m.groupBy("trade_date").agg(F.expr("greatest(least((avg(close / pre_close) - 5) / 40, 0.2), -0.2)").alias("ret"))
    return ops.benchmark_curve(r, bench)


@query("benchmark_curve", f"SELECT trade_date, {six('nav')} AS nav, {six('bench')} AS bench FROM {_CURVE}")
def _(t):
    return _curve(t).select("trade_date", r6("nav").alias("nav"), r6("bench").alias("bench"))


@query("equity_timing", f"""WITH s AS (SELECT trade_date, CASE WHEN nav >= avg(nav) OVER (ORDER BY trade_date ROWS 2 PRECEDING) THEN 1.0 ELSE 0.5 END AS s FROM {_CURVE}), l AS (SELECT trade_date, lag(s, 1, 1.0) OVER (ORDER BY trade_date) AS s FROM s)
SELECT w.select_date, w.code_id, {six('w.weight * coalesce(l.s, 1)')} AS weight FROM {_WH} w LEFT JOIN l ON l.trade_date = w.select_date""")
def _(t):
    return ops.equity_timing(_wh(t), _curve(t)).select("select_date", "code_id", r6("weight").alias("weight"))


@query("strategy_sweep", f"""WITH r AS (SELECT trade_date, next_return, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY score NULLS LAST) END AS r FROM {_SCORE}),
d AS (SELECT config_id, trade_date, avg(next_return) * max(timing) AS x FROM r JOIN (VALUES ('a', 5, 1.0), ('b', 10, 1.0), ('c', 10, 0.5), ('d', 30, 1.0)) s(config_id, n, timing) ON r.r <= n GROUP BY 1, 2)
SELECT config_id, {six('avg(x)')} AS mean, {six('stddev_samp(x)')} AS std, count(x) AS dates FROM d GROUP BY 1""")
def _(t):
    s = t.spark.createDataFrame([("a", 5, 1.0), ("b", 10, 1.0), ("c", 10, 0.5), ("d", 30, 1.0)], "config_id string, n int, timing double")
    return ops.strategy_sweep(_scored(t), s).select("config_id", r6("mean").alias("mean"), r6("std").alias("std"), "dates")
