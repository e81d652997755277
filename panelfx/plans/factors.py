from pyspark.sql import functions as F

from ..functions import div, r2, r4, r6
from ..operators import factors as ops
from .registry import query, six

def _frame(n, name="f"):
    return f"{name} AS (PARTITION BY code_id ORDER BY trade_date ROWS {n - 1} PRECEDING)"


def _sql(expr, n, src="bars_d", places=6):
    return f"SELECT code_id, trade_date, {six(expr, places)} AS x FROM {src} WINDOW w AS (PARTITION BY code_id ORDER BY trade_date), {_frame(n)}"


def _one(t, c, src=None, rnd=r6):
    return (src if src is not None else t.bars_d).withColumn("x", c).select("code_id", "trade_date", rnd("x").alias("x"))


@query("label_fwd_return", _sql("lead(open, 6) OVER w / nullif(lead(open, 1) OVER w, 0) - 1", 1))
def _(t):
    return _one(t, ops.label_fwd_return(5))


@query("f_close_std", _sql("CASE WHEN count(close) OVER f = 20 THEN stddev_samp(close) OVER f END", 20, places=4))
def _(t):
    return _one(t, ops.close_std(20), rnd=r4)


@query("f_amount_shrink", f"SELECT code_id, trade_date, {six('CASE WHEN count(amount) OVER s = 3 THEN avg(amount) OVER s END / CASE WHEN count(amount) OVER f = 20 THEN avg(amount) OVER f END')} AS x FROM bars_d WINDOW {_frame(3, 's')}, {_frame(20)}")
def _(t):
    return _one(t, ops.amount_shrink((3, 20)))


@query("f_drawdown", _sql("close / CASE WHEN count(close) OVER f = 20 THEN max(close) OVER f END - 1", 20))
def _(t):
    return _one(t, ops.drawdown(20))


@query("f_sharpe", _sql("CASE WHEN count(r) OVER f = 20 AND stddev_samp(r) OVER f > 1e-12 THEN avg(r) OVER f / stddev_samp(r) OVER f END", 20, "(SELECT *, close / nullif(pre_close, 0) - 1 AS r FROM bars_d)"))
def _(t):
    return _one(t, ops.sharpe(20), t.bars_d.withColumn("pct_change", div("close", "pre_close") - 1))


_ORDERS = "(SELECT *, floor(amount * (CAST(0.3 AS DOUBLE) + code_id % 3 * CAST(0.1 AS DOUBLE))) AS big_buy, floor(amount * CAST(0.35 AS DOUBLE)) AS big_sell FROM bars_d)"


def _orders(t):
    return t.bars_d.withColumns({"big_buy": F.floor(F.col("amount") * (0.3 + F.col("code_id") % 3 * 0.1)).cast("double"), "big_sell": F.floor(F.col("amount") * 0.35).cast("double")})


@query("f_big_order_net", _sql("CASE WHEN count(big_buy - big_sell) OVER f = 10 THEN sum(big_buy - big_sell) OVER f END / CASE WHEN count(amount) OVER f = 10 THEN sum(amount) OVER f END", 10, _ORDERS))
def _(t):
    return _one(t, ops.big_order_net(10), _orders(t))


@query("f_turnover", _sql("CASE WHEN count(tr) OVER f = 5 THEN avg(tr) OVER f END", 5, "(SELECT b.*, b.amount / nullif(b.close * s.float_shares, 0) AS tr FROM bars_d b JOIN securities s ON b.code_id = s.code_id)"))
def _(t):
    return _one(t, ops.turnover_mean(5), t.bars_d.join(t.securities, "code_id").withColumn("turnover", div("amount", F.col("close") * F.col("float_shares"))))


@query("f_amount_mean", _sql("CASE WHEN count(amount) OVER f = 10 THEN avg(amount) OVER f END", 10, places=2))
def _(t):
    return _one(t, ops.amount_mean(10), rnd=r2)


@query("f_amount_std", _sql("CASE WHEN count(amount) OVER f = 10 THEN stddev_samp(amount) OVER f END", 10, places=2))
def _(t):
    return _one(t, ops.amount_std(10), rnd=r2)


@query("f_momentum", _sql("close / nullif(lag(close, 20) OVER w, 0) - 1", 1))
def _(t):
    return _one(t, ops.momentum(20))


@query("f_buy_share", f"SELECT code_id, trade_date, {six('amount / (amount + volume * 10 + close)')} AS x FROM bars_d")
def _(t):
    src = t.bars_d.withColumns({"b1": F.col("amount"), "b2": F.col("volume") * 10, "b3": F.col("close")})
    return _one(t, ops.buy_share("b1", ["b1", "b2", "b3"]), src)


@query("f_market_cap", f"SELECT code_id, trade_date, {six('mv', 2)} AS mv FROM panel")
def _(t):
    return t.panel.select("code_id", "trade_date", r2("mv").alias("mv"))


@query("f_industry", "SELECT code_id, trade_date, industry FROM panel")
def _(t):
    return t.panel.select("code_id", "trade_date", "industry")


@query("f_many", f"""SELECT code_id, trade_date, {six('close / nullif(lag(close, 3) OVER w, 0) - 1')} AS m3, {six('close / nullif(lag(close, 6) OVER w, 0) - 1')} AS m6, {six('CASE WHEN count(close) OVER f = 6 THEN stddev_samp(close) OVER f END', 4)} AS s6
FROM bars_m WINDOW w AS (PARTITION BY code_id ORDER BY trade_date), {_frame(6)}""")
def _(t):
    out = ops.add_factors(t.bars_m, [("momentum", 3, "m3"), ("momentum", 6, "m6"), ("close_std", 6, "s6")])
    return out.select("code_id", "trade_date", r6("m3").alias("m3"), r6("m6").alias("m6"), r4("s6").alias("s6"))
