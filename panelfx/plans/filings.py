from pyspark.sql import functions as F

from ..functions import div, r2, r6
from ..operators import filings as ops
from ..operators import revisions
from ..operators.joins import asof_join
from .registry import query, six

# what was known at each publish date, for the oracles
_SNAP = """(SELECT *, CASE WHEN quarter(report_date) = 1 THEN r ELSE r - max(r) OVER (PARTITION BY code_id, pub ORDER BY q RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) END AS rq FROM (
 SELECT code_id, pub, report_date, q, known_on, r_revenue AS r, b_inventory AS b FROM (SELECT p.code_id, p.publish_date AS pub, f.report_date, f.publish_date AS known_on, f.r_revenue, f.b_inventory, CAST(year(f.report_date) * 4 + quarter(f.report_date) AS INTEGER) AS q,
  row_number() OVER (PARTITION BY p.code_id, p.publish_date, f.report_date ORDER BY f.publish_date DESC) AS rn FROM (SELECT DISTINCT code_id, publish_date FROM filings) p JOIN filings f ON f.code_id = p.code_id AND f.publish_date <= p.publish_date) WHERE rn = 1))"""
_FULL = f"(SELECT *, coalesce(CASE WHEN count(rq) OVER f = 4 THEN sum(rq) OVER f END, CASE WHEN quarter(report_date) = 4 THEN r END) AS ttm FROM {_SNAP} WINDOW f AS (PARTITION BY code_id, pub ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))"


def _bk(x, n):
    return f"max({x}) OVER (PARTITION BY code_id, pub ORDER BY q RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING)" if n else x


def _snap(t):
    s = ops.asof_snapshots(t.filings, ["r_revenue", "b_inventory"]).withColumnsRenamed({"r_revenue": "r", "b_inventory": "b"})
    return s.withColumn("rq", ops.view_quarter("r"))


def _full(t):
    return _snap(t).withColumn("ttm", ops.view_ttm("rq", "r"))


def _snap_query(name, sql, column, rnd=r6, places=6, base="_snap"):
    @query(name, f"SELECT code_id, pub, q, {six(sql, places)} AS value FROM {_SNAP if base == '_snap' else _FULL}")
    def _(t):
        return (_snap(t) if base == "_snap" else _full(t)).withColumn("value", column()).select("code_id", "pub", "q", rnd("value").alias("value"))


_DUE = "CASE quarter({r}) WHEN 1 THEN make_date(year({r}), 4, 30) WHEN 2 THEN make_date(year({r}), 8, 31) WHEN 3 THEN make_date(year({r}), 10, 31) ELSE make_date(year({r}) + 1, 4, 30) END"
_STAT = f"(SELECT report_date, {_DUE.format(r='report_date')} AS publish_date FROM (SELECT CAST(last_day(unnest(generate_series(date_trunc('quarter', a), date_trunc('quarter', b), INTERVAL 3 MONTH)) + INTERVAL 2 MONTH) AS DATE) AS report_date FROM (SELECT min(report_date) AS a, max(report_date) AS b FROM filings)))"


def _stat(t):
    return ops.filing_calendar(t.filings)


@query("statutory_calendar", f"SELECT * FROM {_STAT}")
def _(t):
    return _stat(t)


@query("clean_filings", f"""WITH s AS (SELECT code_id, min(publish_date) AS p0, max(publish_date) AS p1, min(report_date) AS r0, max(report_date) AS r1 FROM filings GROUP BY 1),
u AS (SELECT code_id, report_date, publish_date, r_revenue, b_inventory, 1 AS is_real FROM filings UNION ALL SELECT code_id, d.report_date, d.publish_date, NULL, NULL, 0 FROM s JOIN {_STAT} d ON d.report_date BETWEEN r0 AND r1 AND d.publish_date BETWEEN p0 AND p1),
f AS (SELECT code_id, report_date, publish_date, is_real, last_value(r_revenue IGNORE NULLS) OVER w AS r_revenue, last_value(b_inventory IGNORE NULLS) OVER w AS b_inventory FROM u WINDOW w AS (PARTITION BY code_id, report_date ORDER BY publish_date, is_real ROWS UNBOUNDED PRECEDING))
SELECT code_id, report_date, publish_date, is_real, r_revenue, b_inventory FROM (SELECT *, row_number() OVER (PARTITION BY code_id, report_date, publish_date ORDER BY is_real DESC, r_revenue DESC NULLS LAST) AS k FROM f) WHERE k = 1""")
def _(t):
    return ops.clean_filings(t.filings, _stat(t), ["r_revenue", "b_inventory"])


@query("late_filing_anchor", f"""SELECT code_id, report_date, publish_date, r_revenue, b_inventory FROM filings UNION ALL
SELECT code_id, report_date, due, NULL, NULL FROM (SELECT code_id, report_date, min(publish_date) AS p, {_DUE.format(r='report_date')} AS due FROM filings GROUP BY code_id, report_date) WHERE p > due""")
def _(t):
    return ops.late_filing_anchor(t.filings, ["r_revenue", "b_inventory"])


@query("asof_snapshots", f"SELECT code_id, pub, report_date, q, known_on, r, b FROM {_SNAP}")
def _(t):
    return _snap(t).drop("rq")


@query("quarter_changes", f"""WITH c AS (SELECT DISTINCT a.code_id, a.q, p.publish_date AS pub FROM (SELECT code_id, q, min(known_on) AS first FROM {_SNAP} GROUP BY 1, 2) a
 JOIN filings p ON p.code_id = a.code_id AND p.publish_date >= a.first AND CAST(year(p.report_date) * 4 + quarter(p.report_date) AS INTEGER) BETWEEN a.q - 4 AND a.q)
SELECT s.code_id, s.q, s.pub, s.r AS now, y.r AS year_ago FROM c JOIN {_SNAP} s ON s.code_id = c.code_id AND s.q = c.q AND s.pub = c.pub LEFT JOIN {_SNAP} y ON y.code_id = s.code_id AND y.pub = s.pub AND y.q = s.q - 4""")
def _(t):
    out = revisions.quarter_changes(t.filings, ["r_revenue"], 4)
    return out.select("code_id", "q", "pub", F.col("r_revenue__0").alias("now"), F.col("r_revenue__4").alias("year_ago"))


@query("asof_snapshots_bounded", f"SELECT code_id, pub, report_date, r FROM (SELECT *, max(q) OVER (PARTITION BY code_id, pub) AS m FROM {_SNAP}) WHERE q > m - 5")
def _(t):
    return ops.asof_snapshots(t.filings, ["r_revenue"], 5).select("code_id", "pub", "report_date", F.col("r_revenue").alias("r"))


@query("mark_superseded", "SELECT code_id, report_date, publish_date, coalesce(max(report_date) OVER (PARTITION BY code_id ORDER BY publish_date, report_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > report_date, FALSE) AS superseded FROM filings")
def _(t):
    return ops.mark_superseded(t.filings).select("code_id", "report_date", "publish_date", "superseded")


_BACK = {"prev_q": "1", "same_q": "4", "last_fy": "quarter(a.report_date)", "last_q1": "quarter(a.report_date) + 3", "last_q2": "quarter(a.report_date) + 2", "last_q3": "quarter(a.report_date) + 1"}
_Q = "(year({0}.report_date) * 4 + quarter({0}.report_date))"
_LOOK = "(SELECT a.code_id, a.report_date, a.publish_date, a.r_revenue, " + ", ".join(
    f"(SELECT arg_max(struct_pack(v := b.r_revenue), struct_pack(p := b.publish_date)) FROM filings b WHERE b.code_id = a.code_id AND {_Q.format('b')} = {_Q.format('a')} - ({x}) AND (b.publish_date < a.publish_date OR (b.publish_date = a.publish_date AND b.report_date < a.report_date))).v AS {n}" for n, x in _BACK.items()
) + " FROM filings a)"


@query("filing_history_lookup", f"SELECT * FROM {_LOOK}")
def _(t):
    return ops.filing_history_lookup(t.filings, "r_revenue").select("code_id", "report_date", "publish_date", "r_revenue", *_BACK)


@query("legacy_derive", f"""SELECT code_id, report_date, publish_date, {six('CASE WHEN quarter(report_date) = 1 THEN r_revenue ELSE r_revenue - prev_q END', 2)} AS sq, {six('CASE WHEN same_q < 0 THEN 1 - r_revenue / nullif(same_q, 0) ELSE r_revenue / nullif(same_q, 0) - 1 END')} AS ytd_yoy,
{six('CASE WHEN quarter(report_date) = 4 THEN r_revenue ELSE r_revenue + last_fy - same_q END', 2)} AS ttm FROM {_LOOK}""")
def _(t):
    out = ops.legacy_derive(t.filings, "r_revenue")
    return out.select("code_id", "report_date", "publish_date", r2("sq").alias("sq"), r6("ytd_yoy").alias("ytd_yoy"), r2("ttm").alias("ttm"))


_NAMES = ("r_revenue_ttm", "B_inventory_yoy", "c_cash", "b_inventory_ttm", "R_op_quarter_yoy", "x_other_raw", "b_cash_annual")
_NAMED = "(SELECT code_id, report_date, publish_date, list_extract([" + ", ".join(f"'{n}'" for n in _NAMES) + f"], CAST((code_id + year(report_date) + quarter(report_date)) % {len(_NAMES)} AS INTEGER) + 1) AS name FROM filings)"
_SUFFIX = "regexp_extract(lower(name), '_(quarter_yoy|quarter_qoq|ttm_yoy|quarter|ttm|annual|raw|yoy|qoq)$', 1)"


@query("split_flow_stock", f"""SELECT code_id, report_date, publish_date, name, field, CASE WHEN upper(substr(field, 1, 2)) IN ('R_', 'C_') THEN 'flow' WHEN upper(substr(field, 1, 2)) = 'B_' AND suffix NOT IN ('quarter', 'ttm', 'ttm_yoy', 'quarter_yoy', 'quarter_qoq') THEN 'stock' END AS kind,
 CASE WHEN suffix = '' THEN 'raw' ELSE suffix END AS suffix FROM (SELECT *, {_SUFFIX} AS suffix, CASE WHEN {_SUFFIX} = '' THEN name ELSE substr(name, 1, length(name) - length({_SUFFIX}) - 1) END AS field FROM {_NAMED})""")
def _(t):
    """A field name for each filing, parsed as a column."""
    at = F.pmod(F.col("code_id") + F.year("report_date") + F.quarter("report_date"), F.lit(len(_NAMES))).cast("int") + 1
    named = t.filings.select("code_id", "report_date", "publish_date", F.element_at(F.array(*map(F.lit, _NAMES)), at).alias("name"))
    return named.withColumn("p", ops.split_names(F.col("name"))).select("code_id", "report_date", "publish_date", "name", "p.*")


@query("view_raw", f"SELECT code_id, pub, q, r AS value FROM {_SNAP}")
def _(t):
    return _snap(t).select("code_id", "pub", "q", F.col("r").alias("value"))


_snap_query("view_quarter", "rq", lambda: F.col("rq"), r2, 2)
_snap_query("view_ttm", "ttm", lambda: F.col("ttm"), r2, 2, "_full")


@query("view_annual", f"SELECT code_id, pub, q, r AS value FROM {_SNAP} WHERE quarter(report_date) = 4")
def _(t):
    return ops.view_annual(_snap(t)).select("code_id", "pub", "q", F.col("r").alias("value"))


_PICK = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code_id, pub ORDER BY q DESC) AS k FROM {_FULL}) WHERE k = 1)"


@query("pick_latest_published", f"SELECT code_id, pub, report_date, r, {six('ttm', 2)} AS ttm FROM {_PICK}")
def _(t):
    return ops.pick_latest_published(_full(t), ["r", "ttm"]).select("code_id", "pub", "report_date", "r", r2("ttm").alias("ttm"))


@query("blank_mask", f"SELECT code_id, pub, q, r IS NULL AS is_blank, rq IS NULL AND r IS NOT NULL AS derived_blank FROM {_SNAP}")
def _(t):
    return _snap(t).select("code_id", "pub", "q", F.col("r").isNull().alias("is_blank"), (F.col("rq").isNull() & F.col("r").isNotNull()).alias("derived_blank"))


def _front(t, look_back, views, fields=("r_revenue",)):
    """Monthly bars with views of the newest quarter known on the day, from a sweep over the changes."""
    front = revisions.newest_quarter(revisions.quarter_changes(t.filings, list(fields), look_back))
    return ops.align_to_trade_date(t.bars_m, front.select("code_id", "pub", *(c.alias(n) for n, c in views.items())), list(views))


@query("align_to_trade_date", f"SELECT b.code_id, b.trade_date, p.r, {six('p.ttm', 2)} AS ttm FROM bars_m b ASOF LEFT JOIN {_PICK} p ON b.code_id = p.code_id AND b.trade_date >= p.pub")
def _(t):
    out = _front(t, 4, {"r": revisions.known("r_revenue"), "ttm": revisions.trailing_year("r_revenue")})
    return out.select("code_id", "trade_date", "r", r2("ttm").alias("ttm"))


def _chg(n, x="rq"):
    p = _bk(x, n)
    return f"CASE WHEN {p} < 0 THEN -({x} / nullif({p}, 0) - 1) ELSE {x} / nullif({p}, 0) - 1 END"


_snap_query("fin_qoq", _chg(1), lambda: ops.fin_qoq("rq"))
_snap_query("fin_yoy", _chg(4), lambda: ops.fin_yoy("rq"))
_snap_query("fin_yoy_positive", f"CASE WHEN {_bk('rq', 4)} > 0 THEN rq / nullif({_bk('rq', 4)}, 0) - 1 END", lambda: ops.fin_yoy("rq", True))
_snap_query("fin_qoq_accel", f"(rq / nullif({_bk('rq', 2)}, 0) - 1) - ({_bk('rq', 1)} / nullif({_bk('rq', 5)}, 0) - 1)", lambda: ops.fin_qoq_accel("rq", 1), r2, 2)
_snap_query("fin_qoq_accel_year", f"(rq / nullif({_bk('rq', 4)}, 0) - 1) - ({_bk('rq', 4)} / nullif({_bk('rq', 8)}, 0) - 1)", lambda: ops.fin_qoq_accel("rq", 4), r2, 2)


@query("fin_yoy_accel", f"SELECT code_id, pub, q, {six('y - ' + _bk('y', 1))} AS value FROM (SELECT *, {_chg(4)} AS y FROM {_SNAP})")
def _(t):
    return _snap(t).withColumn("y", ops.fin_yoy("rq")).withColumn("value", ops.fin_yoy_accel("y", 1)).select("code_id", "pub", "q", r6("value").alias("value"))


_snap_query("fin_diff", f"rq - {_bk('rq', 1)}", lambda: ops.fin_diff("rq", 1), r2, 2)
_snap_query("fin_diff_year", f"rq - {_bk('rq', 4)}", lambda: ops.fin_diff("rq", 4), r2, 2)
_snap_query("fin_lag", f"CASE WHEN r IS NOT NULL THEN {_bk('r', 2)} END", lambda: ops.fin_lag("r", 2), r2, 2)
_snap_query("fin_lag_year", f"CASE WHEN r IS NOT NULL THEN {_bk('r', 4)} END", lambda: ops.fin_lag("r", 1, "y"), r2, 2)
_snap_query("fin_lag_fy", f"CASE WHEN r IS NOT NULL THEN CASE quarter(report_date) WHEN 1 THEN {_bk('r', 1)} WHEN 2 THEN {_bk('r', 2)} WHEN 3 THEN {_bk('r', 3)} ELSE {_bk('r', 4)} END END", lambda: ops.fin_lag("r", 1, "fy"), r2, 2)


@query("fin_last_n_array", f"SELECT code_id, pub, q, [{_bk('b', 3)}, {_bk('b', 2)}, {_bk('b', 1)}, b] AS value FROM {_SNAP}")
def _(t):
    return _snap(t).withColumn("value", ops.fin_last_n_array("b", 4)).select("code_id", "pub", "q", "value")


_snap_query("fin_cagr", f"CASE WHEN {_bk('b', 8)} <= 0 THEN 1 - pow(b / nullif({_bk('b', 8)}, 0), 0.5) ELSE pow(b / nullif({_bk('b', 8)}, 0), 0.5) - 1 END", lambda: ops.fin_cagr("b", 2))


@query("fin_stability", f"SELECT code_id, pub, q, {six('CASE WHEN s > 1e-9 THEN m / s END', 4)} AS value FROM (SELECT code_id, pub, q, list_aggregate(l, 'avg') AS m, list_aggregate(l, 'stddev_samp') AS s FROM (SELECT *, list_filter([b, {_bk('b', 4)}, {_bk('b', 8)}], lambda x: x IS NOT NULL) AS l FROM {_SNAP}))")
def _(t):
    from ..functions import r4

    return _snap(t).withColumn("value", ops.fin_stability("b", 2)).select("code_id", "pub", "q", r4("value").alias("value"))


_FRONT = "(SELECT DISTINCT code_id, publish_date, report_date, first_publish FROM (SELECT code_id, publish_date, report_date, min(publish_date) OVER (PARTITION BY code_id, report_date ORDER BY publish_date) AS first_publish, max(report_date) OVER (PARTITION BY code_id ORDER BY publish_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS newest FROM filings) WHERE report_date = newest)"


@query("fin_publish_dates", f"SELECT b.code_id, b.trade_date, f.report_date, f.first_publish, f.publish_date AS latest_publish FROM bars_m b ASOF LEFT JOIN {_FRONT} f ON b.code_id = f.code_id AND b.trade_date >= f.publish_date")
def _(t):
    return ops.fin_publish_dates(t.bars_m, t.filings).select("code_id", "trade_date", "report_date", "first_publish", "latest_publish")


@query("fin_report_meta", f"SELECT b.code_id, b.trade_date, p.report_date, p.pub AS publish_date FROM bars_m b ASOF LEFT JOIN {_PICK} p ON b.code_id = p.code_id AND b.trade_date >= p.pub")
def _(t):
    return asof_join(t.bars_m, revisions.newest_report(t.filings), "code_id", "trade_date", "pub", ["report_date"], keep_time="publish_date").select("code_id", "trade_date", "report_date", "publish_date")


@query("fin_columns", f"""WITH x AS (SELECT *, {_chg(4)} AS qy, {_chg(1, 'b')} AS bq FROM {_FULL}), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code_id, pub ORDER BY q DESC) AS k FROM x) WHERE k = 1)
SELECT b.code_id, b.trade_date, p.r AS r_revenue, {six('rq', 2)} AS r_revenue_quarter, {six('ttm', 2)} AS r_revenue_ttm, {six('qy')} AS r_revenue_quarter_yoy, {six('bq')} AS b_inventory_qoq FROM bars_m b ASOF LEFT JOIN p ON b.code_id = p.code_id AND b.trade_date >= p.pub""")
def _(t):
    out = revisions.fin_columns(t.filings, t.bars_m, ["r_revenue", "r_revenue_quarter", "r_revenue_ttm", "r_revenue_quarter_yoy", "b_inventory_qoq"])
    return out.select("code_id", "trade_date", "r_revenue", r2("r_revenue_quarter").alias("r_revenue_quarter"), r2("r_revenue_ttm").alias("r_revenue_ttm"), r6("r_revenue_quarter_yoy").alias("r_revenue_quarter_yoy"), r6("b_inventory_qoq").alias("b_inventory_qoq"))


@query("fin_same_period_join", f"""WITH h AS (SELECT * FROM {_LOOK} QUALIFY row_number() OVER (PARTITION BY code_id, publish_date ORDER BY report_date DESC) = 1),
j AS (SELECT b.code_id, b.trade_date, {', '.join('h.' + n for n in _BACK)} FROM bars_m b ASOF LEFT JOIN h ON b.code_id = h.code_id AND b.trade_date >= h.publish_date),
p AS (SELECT * FROM {_SNAP} QUALIFY row_number() OVER (PARTITION BY code_id, pub ORDER BY q DESC) = 1)
SELECT j.code_id, j.trade_date, p.r, {', '.join(f'last_value({n} IGNORE NULLS) OVER w AS {n}' for n in _BACK)} FROM j ASOF LEFT JOIN p ON j.code_id = p.code_id AND j.trade_date >= p.pub
WINDOW w AS (PARTITION BY j.code_id ORDER BY j.trade_date ROWS UNBOUNDED PRECEDING)""")
def _(t):
    out = revisions.same_period_join(t.bars_m, t.filings, "r_revenue")
    return out.select("code_id", "trade_date", F.col("r_revenue").alias("r"), *_BACK)


_snap_query("qdf_shift", _bk("rq", 3), lambda: ops.back("rq", 3), r2, 2)
_snap_query("qdf_diff", f"b - {_bk('b', 2)}", lambda: ops.fin_diff("b", 2), r2, 2)
_snap_query("qdf_pct_change", f"b / nullif({_bk('b', 2)}, 0) - 1", lambda: div(F.col("b"), ops.back("b", 2)) - 1)

for _fn, _duck in (("mean", "avg"), ("std", "stddev_samp"), ("var", "var_samp"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median")):
    _w = "(PARTITION BY code_id, pub ORDER BY q RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)"
    _snap_query(f"qdf_rolling_{_fn}" if _fn != "mean" else "qdf_rolling", f"CASE WHEN count(b) OVER {_w} = 4 THEN {_duck}(b) OVER {_w} END", lambda f=_fn: ops.qdf_rolling("b", 4, f), r2, 2)


@query("qdf_arith", f"SELECT code_id, pub, q, {six('(rq - ' + _bk('rq', 4) + ') / nullif(b, 0)')} AS value FROM {_SNAP}")
def _(t):
    left = _snap(t).withColumn("d", ops.fin_diff("rq", 4)).select("code_id", "pub", "q", "d")
    right = _snap(t).select("code_id", "pub", "q", "b")
    return ops.qdf_arith(left, right, div("d", "b")).select("code_id", "pub", "q", r6("value").alias("value"))


@query("qdf_to_long", f"SELECT code_id, pub, report_date, {six('rq', 2)} AS value FROM {_PICK}")
def _(t):
    return ops.pick_latest_published(_snap(t), ["rq"]).select("code_id", "pub", "report_date", r2("rq").alias("value"))


@query("aligned_arith", f"SELECT b.code_id, b.trade_date, {six('p.r / nullif(b.amount, 0)')} AS sp, {six('p.b + p.r', 2)} AS total FROM bars_m b ASOF LEFT JOIN {_PICK} p ON b.code_id = p.code_id AND b.trade_date >= p.pub")
def _(t):
    a = _front(t, 0, {"r": revisions.known("r_revenue"), "b": revisions.known("b_inventory")}, ("r_revenue", "b_inventory"))
    return a.select("code_id", "trade_date", r6(div("r", "amount")).alias("sp"), r2(F.col("b") + F.col("r")).alias("total"))


_VAL = f"SELECT b.code_id, b.trade_date, {{c}} FROM (SELECT m.*, m.close * s.float_shares AS mv FROM bars_m m JOIN securities s ON m.code_id = s.code_id) b ASOF LEFT JOIN (SELECT *, {_chg(4)} AS qy, {_chg(4, 'b')} AS by FROM {_FULL} QUALIFY row_number() OVER (PARTITION BY code_id, pub ORDER BY q DESC) = 1) p ON b.code_id = p.code_id AND b.trade_date >= p.pub"


def _valued(t):
    front = revisions.newest_quarter(revisions.quarter_changes(t.filings, ["r_revenue", "b_inventory"], 5))
    views = {"rq": revisions.single("r_revenue"), "b": revisions.known("b_inventory"), "qy": revisions.VIEWS["quarter_yoy"][1]("r_revenue"), "by": revisions.VIEWS["yoy"][1]("b_inventory")}
    days = t.bars_m.join(t.securities, "code_id").withColumn("mv", F.col("close") * F.col("float_shares"))
    return ops.align_to_trade_date(days, front.select("code_id", "pub", *(c.alias(n) for n, c in views.items())), list(views))


@query("f_value_ratios", _VAL.format(c=f"{six('rq / nullif(mv, 0)', 6)} AS sp, {six('p.b / nullif(mv, 0)', 6)} AS bm"))
def _(t):
    from ..operators.factors import value_ratios

    v = value_ratios("rq", "rq", "b", "mv")
    return _valued(t).select("code_id", "trade_date", r6(v["sp"]).alias("sp"), r6(v["bm"]).alias("bm"))


@query("f_growth", _VAL.format(c=f"{six('qy')} AS revenue_yoy, {six('p.by')} AS inventory_yoy"))
def _(t):
    return _valued(t).select("code_id", "trade_date", r6("qy").alias("revenue_yoy"), r6("by").alias("inventory_yoy"))
