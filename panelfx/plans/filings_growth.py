"""Growth of filed fields on what was filed before, publication dates by quarter, and value and growth factors of all kinds."""

from pyspark.sql import functions as F

from ..functions import div, r2, r6
from ..operators import filings as ops
from ..operators import revisions
from ..sources.fixtures import VIEWS
from .filings import _LOOK, _Q
from .registry import query, six

# stand-in profit, cost and equity: year to date, and a share of the quantity
VIEWS["results"] = """
  SELECT f.code_id, f.report_date, f.publish_date, p.r_profit, p.r_cost, f.r_revenue, f.b_inventory * 100 AS b_equity FROM filings f JOIN (
    SELECT code_id, last_day(make_date(y, q * 3, 1)) AS report_date, CAST(sum(profit) OVER (PARTITION BY code_id, y ORDER BY q) AS DOUBLE) AS r_profit, CAST(sum(cost) OVER (PARTITION BY code_id, y ORDER BY q) AS DOUBLE) AS r_cost
    FROM (SELECT l_suppkey AS code_id, CAST(year(l_shipdate) AS INTEGER) AS y, CAST(quarter(l_shipdate) AS INTEGER) AS q,
                 sum(CAST(floor(l_extendedprice * (CAST(0.05 AS DOUBLE) - l_discount)) AS DECIMAL(18,0))) AS profit, sum(CAST(floor(l_extendedprice * (CAST(0.5 AS DOUBLE) + l_tax)) AS DECIMAL(18,0))) AS cost
          FROM lineitem GROUP BY l_suppkey, year(l_shipdate), quarter(l_shipdate)) g) p ON f.code_id = p.code_id AND f.report_date = p.report_date"""


def _g(cur, base):
    return f"CASE WHEN {base} < 0 THEN 1 - {cur} / nullif({base}, 0) ELSE {cur} / nullif({base}, 0) - 1 END"


_DERIVED = f"""(SELECT l.*, f.b_inventory AS inv, CAST({_Q.format('l')} AS INTEGER) AS qi, CASE WHEN quarter(l.report_date) = 1 THEN l.r_revenue ELSE l.r_revenue - prev_q END AS sq,
 CASE WHEN quarter(l.report_date) = 4 THEN l.r_revenue ELSE l.r_revenue + last_fy - same_q END AS ttm, {_g('l.r_revenue', 'same_q')} AS ytd_yoy
 FROM {_LOOK} l JOIN filings f ON f.code_id = l.code_id AND f.report_date = l.report_date AND f.publish_date = l.publish_date)"""


def _before(n):
    return f"""(SELECT a.code_id, a.report_date, a.publish_date, arg_max(struct_pack(s := b.sq, t := b.ttm, i := b.inv), struct_pack(p := b.publish_date, r := b.report_date)) AS v FROM x a JOIN x b
 ON b.code_id = a.code_id AND b.qi = a.qi - {n} AND (b.publish_date < a.publish_date OR (b.publish_date = a.publish_date AND b.report_date < a.report_date)) GROUP BY 1, 2, 3)"""


@query("legacy_growth", f"""WITH x AS {_DERIVED}, o AS (SELECT *, coalesce(max(report_date) OVER (PARTITION BY code_id ORDER BY publish_date, report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > report_date, FALSE) AS old FROM filings)
SELECT x.code_id, x.report_date, x.publish_date, {six('x.sq', 2)} AS sq, {six('x.ttm', 2)} AS ttm, {six('x.ytd_yoy')} AS ytd_yoy, {six(_g('x.sq', 'p.v.s'))} AS sq_qoq, {six(_g('x.sq', 'y.v.s'))} AS sq_yoy, {six(_g('x.ttm', 'y.v.t'))} AS ttm_yoy,
 {six(_g('x.inv', 'p.v.i'))} AS stock_qoq, {six(_g('x.inv', 'y.v.i'))} AS stock_yoy
FROM x JOIN o ON o.code_id = x.code_id AND o.report_date = x.report_date AND o.publish_date = x.publish_date AND NOT o.old
LEFT JOIN {_before(1)} p ON p.code_id = x.code_id AND p.report_date = x.report_date AND p.publish_date = x.publish_date
LEFT JOIN {_before(4)} y ON y.code_id = x.code_id AND y.report_date = x.report_date AND y.publish_date = x.publish_date""")
def _(t):
    out = ops.legacy_growth(t.filings, "r_revenue", "b_inventory")
    grown = [r6(c).alias(c) for c in ("ytd_yoy", "sq_qoq", "sq_yoy", "ttm_yoy", "stock_qoq", "stock_yoy")]
    return out.select("code_id", "report_date", "publish_date", r2("sq").alias("sq"), r2("ttm").alias("ttm"), *grown)


_OF_QUARTER = """SELECT b.code_id, b.trade_date, {k} AS quarter, f.report_date, f.first_publish, f.publish_date AS latest_publish FROM bars_m b ASOF LEFT JOIN
 (SELECT DISTINCT code_id, publish_date, report_date, first_publish FROM (SELECT code_id, publish_date, report_date, min(publish_date) OVER (PARTITION BY code_id, report_date ORDER BY publish_date) AS first_publish,
  max(report_date) OVER (PARTITION BY code_id ORDER BY publish_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM filings WHERE quarter(report_date) = {k}) WHERE report_date = newest) f
 ON b.code_id = f.code_id AND b.trade_date >= f.publish_date"""


@query("fin_publish_dates_quarter", " UNION ALL ".join(_OF_QUARTER.format(k=k) for k in (1, 2, 3, 4)))
def _(t):
    parts = [ops.fin_publish_dates(t.bars_m, t.filings, k).select("code_id", "trade_date", F.lit(k).alias("quarter"), "report_date", "first_publish", "latest_publish") for k in (1, 2, 3, 4)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def _at(x, n):
    return f"max({x}) OVER (PARTITION BY code_id, pub ORDER BY q RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)"


_FIELDS = ("r_revenue", "r_profit", "r_cost", "b_equity")
_RESULTS = f"""s AS (SELECT p.code_id, p.publish_date AS pub, f.report_date, CAST(year(f.report_date) * 4 + quarter(f.report_date) AS INTEGER) AS q, {', '.join('f.' + c for c in _FIELDS)},
  row_number() OVER (PARTITION BY p.code_id, p.publish_date, f.report_date ORDER BY f.publish_date DESC) AS rn
  FROM (SELECT DISTINCT code_id, publish_date FROM results) p JOIN results f ON f.code_id = p.code_id AND f.publish_date <= p.publish_date),
u AS (SELECT *, {', '.join(f"CASE WHEN quarter(report_date) = 1 THEN {c} ELSE {c} - {_at(c, 1)} END AS {n}" for c, n in (('r_revenue', 'rq'), ('r_profit', 'pq'), ('r_cost', 'cq')))} FROM (SELECT * FROM s WHERE rn = 1)),
m AS (SELECT *, (rq - cq) / nullif(rq, 0) AS gm FROM u),
x AS (SELECT *, {_at('pq', 4)} AS p4, {_at('pq', 1)} AS p1, {_at('gm', 1)} AS g1 FROM m),
y AS (SELECT *, row_number() OVER (PARTITION BY code_id, pub ORDER BY q DESC) AS k FROM x)"""


def _results(t, views):
    """Views of the newest quarter known, by publish date."""
    front = revisions.newest_quarter(revisions.quarter_changes(t.results, list(_FIELDS), 5))
    return front.select("code_id", "pub", *(c.alias(n) for n, c in views.items()))


def _margin(k):
    return div(revisions.single("r_revenue", k) - revisions.single("r_cost", k), revisions.single("r_revenue", k))


@query("f_growth_profit", f"""WITH {_RESULTS} SELECT b.code_id, b.trade_date, {six('CASE WHEN p4 < 0 THEN -(pq / nullif(p4, 0) - 1) ELSE pq / nullif(p4, 0) - 1 END')} AS profit_yoy,
 {six('CASE WHEN p1 < 0 THEN -(pq / nullif(p1, 0) - 1) ELSE pq / nullif(p1, 0) - 1 END')} AS eps_qoq, {six('gm - g1')} AS gross_margin_change, {six('pq / nullif(b_equity, 0)')} AS roe
FROM bars_m b ASOF LEFT JOIN (SELECT * FROM y WHERE k = 1) p ON b.code_id = p.code_id AND b.trade_date >= p.pub""")
def _(t):
    """Shares are constant here, so earnings per share grow as the quarter's profit does."""
    profit, before, year_ago = (revisions.single("r_profit", k) for k in (0, 1, 4))
    cols = {"profit_yoy": revisions.change(profit, year_ago), "eps_qoq": revisions.change(profit, before), "gross_margin_change": _margin(0) - _margin(1), "roe": div(profit, "b_equity__0")}
    return ops.align_to_trade_date(t.bars_m, _results(t, cols), list(cols)).select("code_id", "trade_date", *(r6(c).alias(c) for c in cols))


@query("f_value_profit", f"""WITH {_RESULTS} SELECT b.code_id, b.trade_date, {six('pq / nullif(mv, 0)')} AS ep, {six('rq / nullif(mv, 0)')} AS sp, {six('b_equity / nullif(mv, 0)')} AS bm
FROM (SELECT m.*, m.close * s.float_shares AS mv FROM bars_m m JOIN securities s ON m.code_id = s.code_id) b ASOF LEFT JOIN (SELECT * FROM y WHERE k = 1) p ON b.code_id = p.code_id AND b.trade_date >= p.pub""")
def _(t):
    from ..operators.factors import value_ratios

    days = t.bars_m.join(t.securities, "code_id").withColumn("mv", F.col("close") * F.col("float_shares"))
    v = value_ratios("pq", "rq", "b_equity", "mv")
    views = {"pq": revisions.single("r_profit"), "rq": revisions.single("r_revenue"), "b_equity": revisions.known("b_equity")}
    out = ops.align_to_trade_date(days, _results(t, views), list(views))
    return out.select("code_id", "trade_date", *(r6(v[c]).alias(c) for c in ("ep", "sp", "bm")))
