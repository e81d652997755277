from pyspark.sql import functions as F

from ..functions import r6
from ..operators import selection as ops
from ..operators.bars import classify_board
from .cross_section import _SCORE
from .registry import query, six


def _scored(t):
    from ..operators.cross_section import composite_score

    return composite_score(t.panel, [("momentum", False, 1.5), ("mv", True, 0.5)])


@query("rebalance_calendar", """SELECT 'M_0:' || date_trunc('month', trade_date)::DATE::VARCHAR AS period_id, max(trade_date) AS select_date FROM calendar GROUP BY 1
UNION ALL SELECT 'W_0:' || date_trunc('week', trade_date)::DATE::VARCHAR, max(trade_date) FROM calendar GROUP BY 1
UNION ALL SELECT '5_2:' || CAST(floor((rn - 2) / 5.0) AS BIGINT)::VARCHAR, max(trade_date) FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS rn FROM calendar) GROUP BY 1""")
def _(t):
    return ops.rebalance_calendar(t.calendar, "M").unionByName(ops.rebalance_calendar(t.calendar, "W")).unionByName(ops.rebalance_calendar(t.calendar, "5", 2))


@query("rebalance_weeks", "SELECT '2W_1:' || CAST(floor((w - 1) / 2.0) AS BIGINT)::VARCHAR AS period_id, max(trade_date) AS select_date FROM (SELECT trade_date, dense_rank() OVER (ORDER BY date_trunc('week', trade_date)) - 1 AS w FROM calendar) GROUP BY 1")
def _(t):
    return ops.rebalance_calendar(t.calendar, "2W", 1)


_SEL = f"(SELECT trade_date, code_id, score, 1.0 / count(*) OVER (PARTITION BY trade_date) AS weight FROM (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY score NULLS LAST) END AS r, count(*) OVER (PARTITION BY trade_date) AS n FROM {_SCORE}) WHERE r <= {{lim}})"
_TOP = _SEL.format(lim="10")


def _sel(t, n=10):
    return ops.select_topn(_scored(t), n)


@query("select_topn", f"SELECT trade_date, code_id, {six('weight')} AS weight FROM {_TOP}")
def _(t):
    return _sel(t).select("trade_date", "code_id", r6("weight").alias("weight"))


@query("select_topn_share", f"SELECT trade_date, code_id, {six('weight')} AS weight FROM {_SEL.format(lim='n * CAST(0.1 AS DOUBLE)')}")
def _(t):
    return _sel(t, 0.1).select("trade_date", "code_id", r6("weight").alias("weight"))


@query("post_filter", f"SELECT trade_date, s.code_id, {six('weight')} AS weight FROM {_TOP} s JOIN securities USING (code_id) WHERE name NOT LIKE '%ST%'")
def _(t):
    return ops.post_filter(_sel(t), ~F.col("name").contains("ST")).select("trade_date", "code_id", r6("weight").alias("weight"))


@query("timing_scope", f"SELECT trade_date, code_id, score FROM (SELECT *, CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY score NULLS LAST) END AS r, count(score) OVER (PARTITION BY trade_date) AS n FROM {_SCORE}) WHERE r / n <= 0.2")
def _(t):
    return ops.timing_scope(_scored(t), 0.2).select("trade_date", "code_id", "score")


def _weights(t):
    return _sel(t).select(F.lit("s").alias("strategy"), F.col("trade_date").alias("select_date"), "code_id", "weight")


_W = f"(SELECT 's' AS strategy, trade_date AS select_date, code_id, weight FROM {_TOP})"
_SIG = "(SELECT trade_date AS select_date, CAST(CASE WHEN month(trade_date) % 3 = 0 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS signal FROM calendar WHERE day(trade_date) = 1 AND month(trade_date) > 2)"


def _signal(t):
    return t.calendar.where("day(trade_date) = 1 and month(trade_date) > 2").select(F.col("trade_date").alias("select_date"), F.when(F.month("trade_date") % 3 == 0, 0.5).otherwise(0.8).alias("signal"))


@query("timing_apply", f"SELECT w.select_date, code_id, {six('weight * CASE WHEN w.select_date = (SELECT max(select_date) FROM ' + _W + ') THEN 0.25 ELSE coalesce(signal, 1.0) END')} AS weight FROM {_W} w LEFT JOIN {_SIG} g ON w.select_date = g.select_date")
def _(t):
    return ops.timing_apply(_weights(t), _signal(t), 0.25).select("select_date", "code_id", r6("weight").alias("weight"))


_OVER = "(SELECT 's' AS strategy, trade_date AS select_date, CAST(0.9 AS DOUBLE) AS signal FROM calendar WHERE day(trade_date) IN (1, 10, 20) AND month(trade_date) % 4 = 1)"


@query("override_positions", f"""WITH w AS {_W}, d AS (SELECT DISTINCT strategy, select_date AS base_date FROM w),
n AS (SELECT o.*, d.base_date FROM (SELECT * FROM {_OVER} o WHERE select_date NOT IN (SELECT base_date FROM d)) o ASOF JOIN d ON o.strategy = d.strategy AND o.select_date >= d.base_date),
f AS (SELECT *, exp(sum(ln(signal)) OVER (PARTITION BY strategy, base_date ORDER BY select_date)) AS factor FROM n)
SELECT select_date, code_id, {six('weight')} AS weight FROM w UNION ALL SELECT f.select_date, w.code_id, {six('w.weight * f.factor')} FROM w JOIN f ON w.strategy = f.strategy AND w.select_date = f.base_date""")
def _(t):
    over = t.calendar.where("day(trade_date) in (1, 10, 20) and month(trade_date) % 4 = 1").select(F.lit("s").alias("strategy"), F.col("trade_date").alias("select_date"), F.lit(0.9).alias("signal"))
    return ops.override_positions(_weights(t), over).select("select_date", "code_id", r6("weight").alias("weight"))


_STAGED = f"""WITH RECURSIVE s AS (SELECT DISTINCT 's' || year(select_date) AS strategy, select_date, month(select_date) % 2 AS stage, code_id FROM {_W}),
d AS (SELECT strategy, select_date, row_number() OVER (PARTITION BY strategy ORDER BY select_date) - 1 AS k, count(*) OVER (PARTITION BY strategy) AS last
  FROM (SELECT DISTINCT strategy, select_date FROM s)),
dd AS (SELECT d.strategy, select_date, k, last, CAST(CASE WHEN n = 2 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS target FROM d
  JOIN (SELECT a.strategy, a.k, count(*) AS n FROM d a JOIN (SELECT strategy, stage, min(select_date) AS f FROM s GROUP BY 1, 2) b
        ON a.strategy = b.strategy AND b.f <= a.select_date GROUP BY 1, 2) USING (strategy, k)),
v AS (SELECT strategy, stage, k, coalesce(lead(k) OVER (PARTITION BY strategy, stage ORDER BY k), last) AS until
  FROM (SELECT DISTINCT strategy, stage, k, last FROM s JOIN dd USING (strategy, select_date))),
p AS (SELECT s.strategy, s.code_id, dd.k, v.until FROM s JOIN dd USING (strategy, select_date) JOIN v ON v.strategy = s.strategy AND v.stage = s.stage AND v.k = dd.k),
q AS (SELECT *, CASE WHEN k <= max(until) OVER (PARTITION BY strategy, code_id ORDER BY k, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS apart FROM p),
i AS (SELECT strategy, code_id, min(k) AS entry, max(until) AS leave FROM (SELECT *, sum(apart) OVER (PARTITION BY strategy, code_id ORDER BY k, until ROWS UNBOUNDED PRECEDING) AS run FROM q)
  GROUP BY strategy, code_id, run),
c AS (SELECT strategy, entry, leave, count(*) AS n FROM i GROUP BY 1, 2, 3),
r(strategy, k, entry, leave, n, share) AS (
  SELECT c.strategy, dd.k, c.entry, c.leave, c.n, target / sum(c.n) OVER (PARTITION BY c.strategy) FROM c JOIN dd ON dd.strategy = c.strategy AND dd.k = 0 AND c.entry = 0
  UNION ALL
  SELECT strategy, k, entry, leave, n, CASE WHEN entry < k THEN share * CASE WHEN held > target THEN target / held ELSE 1 END ELSE (target - least(held, target)) / fresh END
  FROM (SELECT m.*, dd.target, sum(CASE WHEN entry < m.k THEN n * share ELSE 0 END) OVER w AS held, sum(CASE WHEN entry = m.k THEN n ELSE 0 END) OVER w AS fresh
    FROM (SELECT strategy, k + 1 AS k, entry, leave, n, share FROM r WHERE leave > k + 1
      UNION ALL SELECT c.strategy, c.entry, c.entry, c.leave, c.n, CAST(0 AS DOUBLE) FROM c JOIN (SELECT DISTINCT strategy, k FROM r) x ON c.strategy = x.strategy AND c.entry = x.k + 1) m
    JOIN dd ON dd.strategy = m.strategy AND dd.k = m.k WINDOW w AS (PARTITION BY m.strategy))
)
SELECT i.strategy, dd.select_date, i.code_id, {six('a.share')} AS share
FROM (SELECT DISTINCT strategy, k, entry, share FROM r) a JOIN i ON i.strategy = a.strategy AND i.entry = a.entry AND a.k < i.leave JOIN dd ON dd.strategy = a.strategy AND dd.k = a.k"""


@query("staged_entry", _STAGED)
def _(t):
    staged = _weights(t).withColumn("strategy", F.concat(F.lit("s"), F.year("select_date").cast("string")))
    return ops.staged_entry(staged.withColumn("stage", F.month("select_date") % 2), [0.5, 1.0]).withColumn("share", r6("share"))


@query("staged_entry_one_stage", f"SELECT strategy, select_date, code_id, {six('weight')} AS share FROM {_W} WHERE weight IS NOT NULL AND select_date = (SELECT min(select_date) FROM {_W})")
def _(t):
    """With a single stage and date, the target is split evenly."""
    w = _weights(t)
    first = w.agg(F.min("select_date").alias("m"))
    one = w.join(first, w.select_date == first.m).withColumn("stage", F.lit(0))
    return ops.staged_entry(one, [1.0]).withColumn("share", r6("share"))


_STRAT = "(VALUES ('a', CAST(0.9 AS DOUBLE)), ('b', CAST(0.6 AS DOUBLE))) s(strategy, strategy_weight)"


def _two(t):
    w = _weights(t)
    a = w.withColumn("strategy", F.lit("a")).withColumn("share", F.when(F.month("select_date") < 7, 0.5))
    return ops.union_strategies(a, w.where("code_id % 2 = 0").withColumn("strategy", F.lit("b")))


_TWO = f"(SELECT 'a' AS strategy, select_date, code_id, weight, CASE WHEN month(select_date) < 7 THEN CAST(0.5 AS DOUBLE) END AS share FROM {_W} UNION ALL SELECT 'b', select_date, code_id, weight, NULL FROM {_W} WHERE code_id % 2 = 0)"


@query("final_weight", f"SELECT t.strategy, select_date, code_id, {six('weight * strategy_weight / 1.5 * coalesce(share, 1.0)')} AS weight FROM {_TWO} t JOIN {_STRAT} ON t.strategy = s.strategy")
def _(t):
    s = t.spark.createDataFrame([("a", 0.9), ("b", 0.6)], "strategy string, strategy_weight double")
    return ops.final_weight(_two(t), s).select("strategy", "select_date", "code_id", r6("weight").alias("weight"))


@query("union_strategies", f"SELECT strategy, select_date, code_id, {six('weight')} AS weight, share FROM {_TWO}")
def _(t):
    return _two(t).select("strategy", "select_date", "code_id", r6("weight").alias("weight"), "share")


@query("latest_selection", f"SELECT strategy, select_date, code_id FROM (SELECT *, max(select_date) OVER (PARTITION BY strategy) AS m FROM {_TWO}) WHERE select_date = m")
def _(t):
    return ops.latest_selection(_two(t)).select("strategy", "select_date", "code_id")


@query("weights_matrix", f"WITH w AS {_W} SELECT c.code_id, d.select_date, {six('coalesce(w.weight, 0)')} AS weight FROM (SELECT DISTINCT code_id FROM w) c CROSS JOIN (SELECT trade_date AS select_date FROM calendar WHERE day(trade_date) = 1) d LEFT JOIN w ON w.code_id = c.code_id AND w.select_date = d.select_date")
def _(t):
    dates = t.calendar.where("day(trade_date) = 1").select(F.col("trade_date").alias("select_date"))
    return ops.weights_matrix(_weights(t), dates).select("code_id", "select_date", r6("weight").alias("weight"))


@query("weights_with_exits", f"""WITH w AS (SELECT * FROM {_TWO}), d AS (SELECT select_date, row_number() OVER (ORDER BY select_date) AS k, lead(select_date) OVER (ORDER BY select_date) AS next
  FROM (SELECT DISTINCT trade_date AS select_date FROM calendar WHERE day(trade_date) = 1)),
h AS (SELECT strategy, code_id, select_date, k, next, sum(weight) AS weight FROM w JOIN d USING (select_date) GROUP BY ALL)
SELECT strategy, code_id, select_date, {six('weight')} AS weight FROM h UNION ALL
SELECT a.strategy, a.code_id, a.next, 0 FROM h a LEFT JOIN h b ON b.strategy = a.strategy AND b.code_id = a.code_id AND b.k = a.k + 1 WHERE b.k IS NULL AND a.next IS NOT NULL""")
def _(t):
    dates = t.calendar.where("day(trade_date) = 1").select(F.col("trade_date").alias("select_date"))
    return ops.weights_with_exits(_two(t), dates).withColumn("weight", r6("weight"))


@query("period_weights", f"SELECT 'P' || industry || '_' || o AS period_id, {six('sum(w / 2)')} AS weight FROM (SELECT industry, float_shares / 1000000 AS w, unnest([0, code_id % 3 + 1]) AS o FROM securities) GROUP BY 1")
def _(t):
    s = t.securities.select((F.col("float_shares") / 1000000).alias("strategy_weight"), F.concat(F.lit("P"), F.col("industry")).alias("period"), F.array(F.lit(0).cast("long"), F.col("code_id") % 3 + 1).alias("offsets"))
    return ops.period_weights(s).withColumn("weight", r6("weight"))


@query("lot_round", f"""SELECT trade_date, code_id, CAST(CASE WHEN board = 2 THEN CASE WHEN raw >= 200 THEN raw ELSE 0 END ELSE floor(raw / 100) * 100 END AS BIGINT) AS shares FROM (
SELECT w.trade_date, w.code_id, CASE WHEN code LIKE 'sh68%' THEN 2 ELSE 0 END AS board, floor((1000000 * CAST(0.97 AS DOUBLE)) * weight / close) AS raw FROM {_TOP} w JOIN bars_m b ON w.code_id = b.code_id AND w.trade_date = b.trade_date JOIN securities s ON w.code_id = s.code_id)""")
def _(t):
    return ops.lot_round(_sel(t).withColumn("board", classify_board(F.col("code"))), 1000000.0).select("trade_date", "code_id", "shares")


@query("most_selected_by_year", f"""WITH c AS (SELECT year(select_date) AS year, code_id, count(*) AS times FROM {_W} GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY times DESC) AS r FROM c)
SELECT year, string_agg(code_id || ':' || times, ' ' ORDER BY r, code_id) AS codes FROM r WHERE r <= 3 GROUP BY year""")
def _(t):
    return ops.most_selected_by_year(_weights(t), 3)


_HELD = """(WITH a AS (SELECT trade_date, code_id, rank() OVER (PARTITION BY trade_date ORDER BY momentum DESC) AS rank FROM panel WHERE momentum IS NOT NULL),
g AS (SELECT d.trade_date, c.code_id, a.rank, m.mult FROM (SELECT DISTINCT trade_date FROM a) d CROSS JOIN (SELECT DISTINCT code_id FROM a) c CROSS JOIN (VALUES (CAST(1.0 AS DOUBLE)), (1.5), (2.5)) m(mult) LEFT JOIN a ON a.trade_date = d.trade_date AND a.code_id = c.code_id),
h AS (SELECT *, last_value(CASE WHEN rank <= 10 THEN 1 WHEN rank IS NULL OR rank > ceil(mult * 10) THEN 0 END IGNORE NULLS) OVER (PARTITION BY mult, code_id ORDER BY trade_date) AS held FROM g)
SELECT mult, trade_date, code_id, rank FROM h WHERE held = 1)"""


def _held(t):
    from ..functions import min_rank

    ranked = t.panel.where("momentum is not null").select("trade_date", "code_id", min_rank("momentum", "trade_date", False).alias("rank"))
    return ops.topm_buffer(ranked, 10, [1.0, 1.5, 2.5])


@query("topm_buffer", f"SELECT mult, trade_date, code_id, rank FROM {_HELD}")
def _(t):
    return _held(t)


@query("topm_buffer_report", f"""WITH h AS {_HELD}, k AS (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS k FROM (SELECT DISTINCT trade_date FROM h)),
m AS (SELECT h.*, k, CASE WHEN lag(k) OVER (PARTITION BY mult, code_id ORDER BY k) = k - 1 THEN 0.0 ELSE 1.0 END AS fresh FROM h JOIN k USING (trade_date)),
d AS (SELECT mult, trade_date, avg(fresh) AS turnover, avg(next_return) AS ret FROM m LEFT JOIN (SELECT trade_date, code_id, next_return FROM panel) p USING (trade_date, code_id) GROUP BY mult, trade_date),
a AS (SELECT mult, avg(turnover) AS turnover, avg(ret) AS ret FROM d GROUP BY mult), f AS (SELECT * FROM a ORDER BY mult LIMIT 1)
SELECT a.mult, {six('a.turnover')} AS turnover, {six('a.ret')} AS ret, {six('1 - a.turnover / f.turnover')} AS turnover_cut, {six('a.ret / f.ret')} AS return_kept FROM a, f""")
def _(t):
    out = ops.buffer_report(_held(t), t.panel)
    return out.select("mult", *(r6(c).alias(c) for c in ("turnover", "ret", "turnover_cut", "return_kept")))


@query("period_ratios", f"""WITH w AS (SELECT strategy, CASE strategy WHEN 'a' THEN 'M' ELSE 'W' END AS period, CASE strategy WHEN 'a' THEN '0935' ELSE 'close' END AS time, select_date, code_id, weight FROM {_TWO}),
d AS (SELECT DISTINCT 'M' AS period, trade_date AS select_date FROM bars_m UNION ALL SELECT 'W', max(trade_date) FROM calendar GROUP BY date_trunc('week', trade_date))
SELECT g.strategy, g.period, g.time, d.select_date, c.code_id, {six('coalesce(w.weight, 0)')} AS weight FROM (SELECT DISTINCT strategy, period, time FROM w) g JOIN d ON d.period = g.period CROSS JOIN (SELECT DISTINCT code_id FROM w) c
LEFT JOIN w ON w.strategy = g.strategy AND w.period = g.period AND w.time = g.time AND w.select_date = d.select_date AND w.code_id = c.code_id""")
def _(t):
    a = F.col("strategy") == "a"
    w = _two(t).withColumn("period", F.when(a, "M").otherwise("W")).withColumn("time", F.when(a, "0935").otherwise("close"))
    monthly = t.bars_m.select(F.lit("M").alias("period"), F.col("trade_date").alias("select_date")).distinct()
    weekly = ops.rebalance_calendar(t.calendar, "W").select(F.lit("W").alias("period"), "select_date")
    return ops.period_ratios(w, monthly.unionByName(weekly)).select("strategy", "period", "time", "select_date", "code_id", r6("weight").alias("weight"))
