from pyspark.sql import functions as F

from ..functions import r6
from ..operators import cross_section as xs
from ..operators import evaluate as ops
from .cross_section import _PRE
from .registry import query, six

_RANKED = """(SELECT trade_date, rank() OVER (PARTITION BY trade_date ORDER BY {p}) + (count(*) OVER (PARTITION BY trade_date, {p}) - 1) / 2.0 AS p, rank() OVER (PARTITION BY trade_date ORDER BY {r}) + (count(*) OVER (PARTITION BY trade_date, {r}) - 1) / 2.0 AS r
 FROM {src} WHERE {p} IS NOT NULL AND {r} IS NOT NULL)"""
_IC = "(SELECT trade_date, corr(p, r) AS ic FROM {src} GROUP BY trade_date HAVING count(DISTINCT p) >= 2 AND count(DISTINCT r) >= 2)"
_RANK_IC = _IC.format(src=_RANKED.format(p="momentum", r="next_return", src="panel"))
_SUMMARY = f"SELECT {six('avg(ic)')} AS mean, {six('stddev_samp(ic)')} AS std, {six('avg(ic) / stddev_samp(ic)')} AS ir, {six('avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END)')} AS win, count(ic) AS n FROM "


def _rounded(df, *keep):
    return df.select(*keep, *(r6(c).alias(c) for c, k in df.dtypes if k == "double" and c not in keep), *(c for c, k in df.dtypes if k != "double" and c not in keep))


@query("rank_ic", f"SELECT trade_date, {six('ic')} AS ic FROM {_RANK_IC}")
def _(t):
    return _rounded(ops.rank_ic(t.panel, "momentum", "next_return"))


@query("pearson_ic", f"SELECT trade_date, {six('ic')} AS ic FROM {_IC.format(src='(SELECT trade_date, momentum AS p, next_return AS r FROM panel WHERE momentum IS NOT NULL AND next_return IS NOT NULL)')}")
def _(t):
    return _rounded(ops.pearson_ic(t.panel, "momentum", "next_return"))


@query("ic_summary", f"WITH z AS (SELECT trade_date, z, next_return FROM {_PRE}), i AS {_IC.format(src=_RANKED.format(p='z', r='next_return', src='z'))} {_SUMMARY} i")
def _(t):
    """The flagship chain: factor, clip, neutralise, z-score, rank IC, summary."""
    return _rounded(ops.ic_summary(ops.rank_ic(xs.preprocess_column(t.panel, "momentum"), "momentum", "next_return")))


@query("relative_ic", f"WITH x AS (SELECT trade_date, momentum, next_return - avg(next_return) OVER (PARTITION BY trade_date) AS e FROM panel), i AS {_IC.format(src=_RANKED.format(p='momentum', r='e', src='x'))} {_SUMMARY} i")
def _(t):
    return _rounded(ops.ic_summary(ops.relative_ic(t.panel, "momentum", "next_return")))


@query("cumulative_ic", f"SELECT trade_date, {six('sum(ic) OVER (ORDER BY trade_date)')} AS cum_ic FROM {_RANK_IC}")
def _(t):
    return _rounded(ops.cumulative_ic(ops.rank_ic(t.panel, "momentum", "next_return")).drop("ic"))


_RN = "(SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY momentum DESC NULLS LAST, code_id) AS rn FROM panel)"
_WIDE = f"(SELECT trade_date, avg(CASE WHEN rn <= 3 THEN next_return END) AS top3, avg(CASE WHEN rn <= 10 THEN next_return END) AS top10, avg(next_return) AS market FROM {_RN} GROUP BY trade_date)"


def _wide(t):
    return ops.topn_daily(t.panel, [3, 10], "momentum", "next_return")


@query("topn_daily", f"SELECT trade_date, {six('top3')} AS top3, {six('top10')} AS top10, {six('market')} AS market FROM {_WIDE}")
def _(t):
    return _rounded(_wide(t))


@query("every_kth_date", "SELECT code_id, trade_date, close FROM (SELECT *, dense_rank() OVER (ORDER BY trade_date) - 1 AS k FROM bars_m) WHERE k % 5 = 0")
def _(t):
    return ops.every_kth_date(t.bars_m, 5).select("code_id", "trade_date", "close")


@query("topn_history", f"SELECT trade_date, 'top' || n AS portfolio, rn AS rank, code_id, {six('next_return')} AS next_return, {six('momentum')} AS momentum FROM {_RN} JOIN (VALUES (3), (10)) v(n) ON rn <= n")
def _(t):
    return _rounded(ops.topn_history(t.panel, [3, 10], "momentum", "next_return"), "trade_date", "portfolio", "rank")


# the test tables' prices jump from month to month: returns are scaled to a usual size
_TAME = "greatest(least(({x} - 4.6) / 40, 0.2), -0.2)"
_PERF = f"""WITH l AS (SELECT trade_date, portfolio, {_TAME.format(x='ret')} AS ret FROM (UNPIVOT {_WIDE} ON top3, top10, market INTO NAME portfolio VALUE ret) WHERE ret IS NOT NULL),
n AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS nav FROM l WINDOW w AS (PARTITION BY portfolio ORDER BY trade_date)),
d AS (SELECT *, nav / greatest(max(nav) OVER w, 1) - 1 AS dd FROM n WINDOW w AS (PARTITION BY portfolio ORDER BY trade_date)),
a AS (SELECT portfolio, exp(sum(ln(1 + ret))) - 1 AS total, stddev_samp(ret) * sqrt(250.0 / 20) AS vol, min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win, avg(ret) AS mean, count(*) AS n FROM d GROUP BY portfolio)
SELECT portfolio, {six('total')} AS total, {six('(1 + total) ** (250.0 / n) - 1')} AS annual, {six('vol')} AS vol, {six('((1 + total) ** (250.0 / n) - 1) / vol')} AS sharpe, {six('mdd')} AS max_drawdown, {six('win')} AS win_rate, {six('mean')} AS mean FROM a"""


@query("topn_performance", _PERF)
def _(t):
    return _rounded(ops.topn_performance(ops.long_returns(_wide(t)).where("ret is not null").withColumn("ret", F.expr(_TAME.format(x="ret"))), 20))


@query("topn_excess", f"SELECT trade_date, {six('sum(top3 - market) OVER (ORDER BY trade_date)')} AS cum_excess FROM {_WIDE}")
def _(t):
    return _rounded(ops.topn_excess(_wide(t), "top3"))


_SERIES = f"(SELECT trade_date, {_TAME.format(x='market')} AS ret FROM " + _WIDE + " WHERE market IS NOT NULL)"


def _series(t):
    return _wide(t).where("market is not null").select("trade_date", F.expr(_TAME.format(x="market")).alias("ret"))


def _periods(unit, step):
    return f"""WITH b AS (SELECT CAST(date_trunc('{unit}', trade_date) AS DATE) AS period, exp(sum(ln(1 + ret))) - 1 AS r FROM {_SERIES} GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM b), (SELECT max(period) FROM b), INTERVAL {step})) AS DATE) AS period)
SELECT s.period, {six('coalesce(r, 0)')} AS ret FROM s LEFT JOIN b ON s.period = b.period"""


@query("monthly_returns", _periods("month", "1 MONTH"))
def _(t):
    return _rounded(ops.period_returns(_series(t), "month"), "period")


@query("period_returns_quarter", _periods("quarter", "3 MONTH"))
def _(t):
    return _rounded(ops.period_returns(_series(t), "quarter"), "period")


@query("period_returns", _periods("year", "1 YEAR"))
def _(t):
    return _rounded(ops.period_returns(_series(t), "year"), "period")


@query("performance_summary", f"""WITH c AS (SELECT trade_date AS d, ret AS r, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date)) AS nav FROM {_SERIES}),
p AS (SELECT *, max(nav) OVER (ORDER BY d) AS peak, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY sign(r) ORDER BY d) AS grp FROM c),
q AS (SELECT *, nav / peak - 1 AS dd, count(*) OVER (PARTITION BY sign(r), grp) AS len, (SELECT min(x.d) FROM c x WHERE x.nav = p.peak) AS start FROM p),
l AS (SELECT d, start, dd FROM q ORDER BY dd, d LIMIT 1),
a AS (SELECT arg_max(nav, d) AS nav, max(d) - min(d) AS days, count(r) AS n, avg(r) AS m, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) / sum(CASE WHEN r <> 0 THEN 1.0 ELSE 0.0 END) AS wt,
 avg(CASE WHEN r > 0 THEN r END) / -avg(CASE WHEN r < 0 THEN r END) AS pl, max(r) AS best, min(r) AS worst, coalesce(max(CASE WHEN r > 0 THEN len END), 0) AS lw, coalesce(max(CASE WHEN r < 0 THEN len END), 0) AS ll FROM q)
SELECT {six('nav')} AS nav, {six('nav ** (365.0 / days) - 1')} AS annual, {six('m / std * sqrt(n / days * 365)')} AS sharpe, {six('dd')} AS max_drawdown, start AS drawdown_start, l.d AS drawdown_end, {six('(nav ** (365.0 / days) - 1) / -dd')} AS return_drawdown, {six('1 / (1 + dd) - 1')} AS recovery_gain,
 {six('win_rate')} AS win_rate, {six('wt')} AS win_rate_traded, {six('pl')} AS profit_loss, {six('best')} AS best, {six('worst')} AS worst, lw AS longest_win, ll AS longest_loss, {six('std')} AS std FROM a, l""")
def _(t):
    return _rounded(ops.performance_summary(_series(t)))


@query("performance_report", f"""WITH c AS (SELECT trade_date AS d, ret AS r, abs(ret) AS t, exp(sum(ln(1 + ret)) OVER (ORDER BY trade_date)) AS nav, ret > 0 AS win FROM {_SERIES}),
p AS (SELECT *, nav / max(nav) OVER (ORDER BY d) - 1 AS dd, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY win ORDER BY d) AS grp FROM c),
q AS (SELECT *, count(*) OVER (PARTITION BY win, grp) AS len FROM p),
a AS (SELECT arg_max(nav, d) AS nav, max(d) - min(d) AS days, count(r) AS n, avg(r) AS m, stddev_samp(r) AS std, min(dd) AS dd, avg(1 / (1 + dd) - 1) AS mg, count(*) FILTER (win) AS wins, count(*) FILTER (NOT win) AS losses,
 avg(r) FILTER (win) / -avg(r) FILTER (NOT win) AS pl, coalesce(max(len) FILTER (win), 0) AS lw, coalesce(max(len) FILTER (NOT win), 0) AS ll, avg(t) AS turnover FROM q),
b AS (SELECT *, n / days * 365 AS per_year, nav ** (365.0 / days) - 1 AS annual FROM a)
SELECT {six('nav')} AS nav, {six('annual')} AS annual, {six('per_year')} AS per_year, {six('(m - (1.02 ** (1 / per_year) - 1)) / std * sqrt(per_year)')} AS sharpe, {six('dd')} AS max_drawdown, {six('mg')} AS mean_gain, {six('1 / (1 + dd) - 1')} AS max_gain,
 {six('ln(1 + mg) / ln(1 + annual) * 365', 3)} AS mean_recovery_days, {six('ln(1 / (1 + dd)) / ln(1 + annual) * 365', 3)} AS max_recovery_days, wins, losses, {six('m')} AS mean_return, {six('pl')} AS profit_loss, lw AS longest_win, ll AS longest_loss, {six('turnover')} AS turnover FROM b""")
def _(t):
    out = ops.performance_report(_series(t).withColumn("t", F.abs("ret")), 0.02, "t")
    days = ("mean_recovery_days", "max_recovery_days")
    return out.select(*((F.floor(F.col(c) * 1000 + 0.5) / 1000).alias(c) if c in days else r6(c).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


@query("turnover_of_commission", f"""WITH c AS (SELECT trade_date, abs(ret) * 1000 AS paid, CASE WHEN month(trade_date) = 3 THEN 0 ELSE 1e6 + ret * 1e5 END AS assets FROM {_SERIES})
SELECT trade_date, {six('(paid / 0.0003) / coalesce(lag(nullif(assets, 0)) OVER (ORDER BY trade_date), nullif(assets, 0))')} AS turnover FROM c""")
def _(t):
    c = _series(t).select("trade_date", (F.abs("ret") * 1000).alias("paid"), F.when(F.month("trade_date") == 3, 0).otherwise(F.lit(1e6) + F.col("ret") * 1e5).alias("assets"))
    return c.select("trade_date", r6(ops.turnover_of_commission("paid", "assets", 0.0003)).alias("turnover"))
