from pyspark.sql import functions as F

from ..functions import r6
from ..operators import joins as ops
from ..operators.datasets import rolling_windows
from .datasets import _WIN
from .registry import query, six

_FIL = "(SELECT code_id, publish_date, max(b_inventory) AS b_inventory FROM filings GROUP BY code_id, publish_date)"


def _fil(t):
    return t.filings.groupBy("code_id", "publish_date").agg(F.max("b_inventory").alias("b_inventory"))


@query("asof_join", f"SELECT b.code_id, b.trade_date, b.close, f.b_inventory, f.publish_date AS known_on FROM bars_d b ASOF LEFT JOIN {_FIL} f ON b.code_id = f.code_id AND b.trade_date >= f.publish_date")
def _(t):
    return ops.asof_join(t.bars_d, _fil(t), "code_id", "trade_date", "publish_date", ["b_inventory"], keep_time="known_on").select("code_id", "trade_date", "close", "b_inventory", "known_on")


@query("asof_join_strict", f"SELECT b.code_id, b.trade_date, f.b_inventory FROM bars_d b ASOF LEFT JOIN {_FIL} f ON b.code_id = f.code_id AND b.trade_date > f.publish_date")
def _(t):
    return ops.asof_join(t.bars_d, _fil(t), "code_id", "trade_date", "publish_date", ["b_inventory"], strict=True).select("code_id", "trade_date", "b_inventory")


@query("next_date_map", "SELECT d, coalesce((SELECT min(trade_date) FROM calendar WHERE trade_date > d), (SELECT max(trade_date) FROM calendar)) AS next_date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(t):
    return ops.next_date_map(t.orders.select(F.col("o_orderdate").cast("date").alias("d")).distinct(), t.calendar)


_FOREIGN = """(SELECT o_custkey % (SELECT count(*) FROM supplier) AS code_id, CAST(o_orderdate AS DATE) + 92 AS trade_date, CAST(max(o_totalprice) AS DOUBLE) AS foreign_close
FROM orders WHERE NOT (o_custkey % 10 = 3 AND o_orderdate > DATE '1996-01-01') GROUP BY 1, 2)"""
_FX = "(SELECT CAST(o_orderdate AS DATE) AS trade_date, floor(avg(1 + (o_orderkey % 7) / 10.0) * 1e6 + 0.5) / 1e6 AS rate FROM orders GROUP BY 1)"


@query("ordered_merge_ffill", f"""WITH f AS {_FOREIGN}, x AS {_FX}, h AS (SELECT * FROM bars_m),
ok AS (SELECT a.code_id FROM (SELECT code_id, max(trade_date) AS m FROM f GROUP BY 1) a JOIN (SELECT code_id, max(trade_date) AS m FROM h GROUP BY 1) b ON a.code_id = b.code_id WHERE b.m - a.m <= 10)
SELECT h.code_id, h.trade_date, g.foreign_close, x.rate, {six('g.foreign_close * x.rate', 4)} AS foreign_adj
FROM h ASOF LEFT JOIN (SELECT * FROM f WHERE code_id IN (SELECT code_id FROM ok)) g ON h.code_id = g.code_id AND h.trade_date >= g.trade_date ASOF LEFT JOIN x ON h.trade_date >= x.trade_date""")
def _(t):
    """Over every code: the stand-in foreign codes are spread over as many codes as there are suppliers. Their days are 92
    after the orders', as bars end 95 days after orders: without that, every code would be stale."""
    from ..functions import r4

    n = F.broadcast(t.supplier.agg(F.count("*").alias("n")))
    o = t.orders.crossJoin(n).select(F.expr("o_custkey % n").alias("code_id"), F.col("o_orderdate").cast("date").alias("trade_date"), "o_orderdate", "o_custkey", "o_totalprice", "o_orderkey")
    foreign = o.where(~((F.col("o_custkey") % 10 == 3) & (F.col("o_orderdate") > "1996-01-01"))).groupBy("code_id", F.date_add("trade_date", 92).alias("trade_date")).agg(F.max("o_totalprice").cast("double").alias("foreign_close"))
    fx = o.groupBy("trade_date").agg(r6(F.avg(1 + (F.col("o_orderkey") % 7) / 10.0)).alias("rate"))
    return ops.ordered_merge_ffill(t.bars_m, foreign, fx, "code_id").select("code_id", "trade_date", "foreign_close", "rate", r4("foreign_adj").alias("foreign_adj"))


_DIV = "(SELECT code_id, report_date, max(b_inventory) / 100 AS dividend, 50.0 + code_id % 7 AS close FROM filings WHERE quarter(report_date) IN (2, 4) GROUP BY code_id, report_date)"


@query("dividend_features", f"""WITH d AS (SELECT *, CAST(dividend / close AS DOUBLE) AS y, CAST(year(report_date) * 12 + month(report_date) AS INTEGER) AS m, year(report_date) AS yr FROM {_DIV}),
r AS (SELECT *, yr - dense_rank() OVER (PARTITION BY code_id ORDER BY yr) AS run FROM d)
SELECT code_id, report_date, {six('y')} AS yield, {six('avg(y) OVER w')} AS yield_mean, {six('stddev_samp(y) OVER w')} AS yield_std, count(y) OVER w AS yield_n, yr - min(yr) OVER (PARTITION BY code_id, run) + 1 AS years
FROM r WINDOW w AS (PARTITION BY code_id ORDER BY m RANGE BETWEEN 35 PRECEDING AND CURRENT ROW)""")
def _(t):
    d = t.filings.where(F.quarter("report_date").isin(2, 4)).groupBy("code_id", "report_date").agg((F.max("b_inventory") / 100).alias("dividend")).withColumn("close", (50.0 + F.col("code_id") % 7).cast("double"))
    return ops.dividend_features(d).select("code_id", "report_date", r6("yield").alias("yield"), r6("yield_mean").alias("yield_mean"), r6("yield_std").alias("yield_std"), "yield_n", "years")


@query("bounded_ffill", """WITH a AS (SELECT b.code_id, b.trade_date, CASE WHEN volume > 45 THEN volume END AS v, row_number() OVER (PARTITION BY b.code_id ORDER BY b.trade_date) AS rn FROM bars_d b),
l AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS lv, last_value(CASE WHEN v IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS lr FROM a WINDOW w AS (PARTITION BY code_id ORDER BY trade_date))
SELECT code_id, trade_date, CASE WHEN rn - lr <= 20 THEN lv END AS volume FROM l""")
def _(t):
    big = t.bars_d.withColumn("volume", F.when(F.col("volume") > 45, F.col("volume")))
    return ops.bounded_ffill(big, "volume", 20).select("code_id", "trade_date", "volume")


@query("notice_rollup", """SELECT code_id, trade_date, count(*) AS n_notices, string_agg(title, '==' ORDER BY notice_date, title) AS titles
FROM (SELECT n.*, b.trade_date FROM notices n ASOF JOIN (SELECT DISTINCT code_id, trade_date FROM bars_d) b ON n.code_id = b.code_id AND n.notice_date >= b.trade_date) GROUP BY code_id, trade_date""")
def _(t):
    return ops.notice_rollup(t.notices, t.bars_d)


@query("factor_attach", "SELECT b.code_id, b.trade_date, b.close, f.mom, l.label FROM bars_m b LEFT JOIN (SELECT code_id, trade_date, momentum AS mom FROM panel WHERE momentum > 0) f ON b.code_id = f.code_id AND b.trade_date = f.trade_date LEFT JOIN (SELECT code_id, trade_date, next_return AS label FROM panel WHERE next_return IS NOT NULL) l ON b.code_id = l.code_id AND b.trade_date = l.trade_date")
def _(t):
    mom = t.panel.where("momentum > 0").select("code_id", "trade_date", F.col("momentum").alias("mom"))
    label = t.panel.where("next_return is not null").select("code_id", "trade_date", F.col("next_return").alias("label"))
    return ops.factor_attach(t.bars_m.select("code_id", "trade_date", "close"), mom, label).select("code_id", "trade_date", "close", "mom", "label")


@query("semi_filter_codes", "SELECT code_id, trade_date, close FROM bars_d WHERE code_id IN (SELECT code_id FROM securities WHERE industry = 2)")
def _(t):
    return ops.semi_filter(t.bars_d, t.securities.where("industry = 2").select("code_id"), "code_id").select("code_id", "trade_date", "close")


@query("anti_missing_periods", "SELECT c.code_id, q.report_date FROM (SELECT DISTINCT code_id FROM filings) c CROSS JOIN (SELECT DISTINCT report_date FROM filings) q ANTI JOIN filings f ON c.code_id = f.code_id AND q.report_date = f.report_date")
def _(t):
    quarters = F.broadcast(t.filings.select("report_date").distinct())
    expected = t.filings.select("code_id").distinct().join(quarters, F.lit(True))
    return ops.anti_missing_periods(expected, t.filings, ["code_id", "report_date"])


@query("interval_window_join", f"SELECT code_id, trade_date, window_id, CASE WHEN trade_date < val_start THEN 'train' WHEN trade_date < test_start THEN 'val' ELSE 'test' END AS part FROM bars_m JOIN {_WIN} w ON trade_date >= train_start AND trade_date < test_end")
def _(t):
    windows = rolling_windows(t.bars_m, 24, 6, 3, 3, "1997-01-01")
    return ops.interval_window_join(t.bars_m, windows).select("code_id", "trade_date", "window_id", "part")
