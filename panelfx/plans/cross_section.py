from pyspark.sql import functions as F

from ..functions import r6
from ..operators import bars as bar_ops
from ..operators import cross_section as ops
from .registry import query, six

_FLAGS = """(SELECT code_id, trade_date, name, dense_rank() OVER w * 12 AS listed_days, lead(CASE WHEN volume > 100 THEN 1 ELSE 0 END) OVER w AS next_is_trade, lead(CASE WHEN close > 1900 THEN 1 ELSE 0 END) OVER w AS next_open_up_limit,
 lead(CASE WHEN volume < 150 THEN 1 ELSE 0 END) OVER w AS next_is_st, lead(CASE WHEN volume > 700 THEN 1 ELSE 0 END) OVER w AS next_is_delist, lead(CASE WHEN high = low THEN 1 ELSE 0 END) OVER w AS next_one_price_up
 FROM panel WINDOW w AS (PARTITION BY code_id ORDER BY trade_date))"""
_BAD = "(upper(name) LIKE '%ST%' OR listed_days < 250 OR coalesce(next_is_trade, 0) = 0 OR coalesce(next_open_up_limit, 0) = 1 OR coalesce(next_is_st, 0) = 1 OR coalesce(next_is_delist, 0) = 1 OR coalesce(next_one_price_up, 0) = 1)"


def _flags(t):
    w = bar_ops.history()
    nxt = lambda c: F.lead(F.when(c, 1).otherwise(0)).over(w)
    return t.panel.select(
        "code_id", "trade_date", "name", (F.dense_rank().over(w) * 12).alias("listed_days"), nxt(F.col("volume") > 100).alias("next_is_trade"), nxt(F.col("close") > 1900).alias("next_open_up_limit"),
        nxt(F.col("volume") < 150).alias("next_is_st"), nxt(F.col("volume") > 700).alias("next_is_delist"), nxt(F.col("high") == F.col("low")).alias("next_one_price_up"),
    )


@query("tradable_filter", f"SELECT code_id, trade_date, name FROM {_FLAGS} WHERE NOT {_BAD}")
def _(t):
    return ops.tradable_filter(_flags(t)).select("code_id", "trade_date", "name")


@query("filter_summary", f"""WITH f AS {_FLAGS}, c AS (SELECT count(*) FILTER (upper(name) LIKE '%ST%') AS risk_mark, count(*) FILTER (coalesce(listed_days, 0) < 250) AS new_listing, count(*) FILTER (coalesce(next_is_trade, 0) = 0) AS not_trading,
 count(*) FILTER (next_open_up_limit = 1) AS open_limit, count(*) FILTER (next_is_st = 1) AS next_st, count(*) FILTER (next_is_delist = 1) AS next_delist, count(*) FILTER (next_one_price_up = 1) AS one_price,
 count(*) FILTER (NOT {_BAD}) AS kept, count(*) FILTER ({_BAD}) AS dropped, count(*) AS "all" FROM f)
SELECT reason, n FROM (UNPIVOT c ON COLUMNS(*) INTO NAME reason VALUE n)""")
def _(t):
    return ops.filter_summary(_flags(t))


_CLIP = """(SELECT *, CASE WHEN momentum IS NULL OR coalesce(mad, 0) = 0 THEN momentum ELSE least(greatest(momentum, med - 3 * 1.4826 * mad), med + 3 * 1.4826 * mad) END AS x
 FROM (SELECT *, median(abs(momentum - med)) OVER (PARTITION BY trade_date) AS mad FROM (SELECT *, median(momentum) OVER (PARTITION BY trade_date) AS med FROM panel)))"""


@query("mad_clip", f"SELECT code_id, trade_date, {six('x')} AS x FROM {_CLIP}")
def _(t):
    return ops.clip_column(t.panel, "momentum").select("code_id", "trade_date", r6("momentum").alias("x"))


_NEUTRAL = """(SELECT code_id, trade_date, next_return, CASE WHEN n >= 2 THEN y - CASE WHEN ll > 1e-12 THEN ly / ll ELSE 0 END * l END AS x FROM (
 SELECT *, sum(l * l) OVER d AS ll, sum(l * y) OVER d AS ly, count(y) OVER d AS n FROM (
  SELECT code_id, trade_date, next_return, industry, y - avg(y) OVER i AS y, l - avg(l) OVER i AS l FROM (
   SELECT *, CASE WHEN ok THEN x END AS y, CASE WHEN ok THEN ln(mv) END AS l FROM (SELECT *, x IS NOT NULL AND mv > 0 AND industry IS NOT NULL AS ok FROM {src}))
  WINDOW i AS (PARTITION BY trade_date, industry)) WINDOW d AS (PARTITION BY trade_date)))"""
_Z = "(SELECT *, CASE WHEN count(x) OVER d >= 2 AND stddev_pop(x) OVER d > 1e-12 THEN (x - avg(x) OVER d) / stddev_pop(x) OVER d END AS z FROM {src} WINDOW d AS (PARTITION BY trade_date))"
_MOM = "(SELECT *, momentum AS x FROM panel)"


@query("neutralize", f"SELECT code_id, trade_date, {six('x')} AS x FROM {_NEUTRAL.format(src=_MOM)}")
def _(t):
    return ops.neutralize(t.panel, "momentum").select("code_id", "trade_date", r6("momentum").alias("x"))


@query("neutralize_multi", f"""WITH a AS (SELECT *, CASE WHEN ok THEN momentum END AS y, CASE WHEN ok THEN ln(mv) END AS c1, CASE WHEN ok THEN volume END AS c2 FROM (SELECT *, momentum IS NOT NULL AND mv > 0 AS ok FROM panel)),
b AS (SELECT code_id, trade_date, y - avg(y) OVER i AS y, c1 - avg(c1) OVER i AS c1, c2 - avg(c2) OVER i AS c2 FROM a WINDOW i AS (PARTITION BY trade_date, industry)),
s AS (SELECT *, sum(c1 * c1) OVER d AS s11, sum(c2 * c2) OVER d AS s22, sum(c1 * c2) OVER d AS s12, sum(c1 * y) OVER d AS s1y, sum(c2 * y) OVER d AS s2y FROM b WINDOW d AS (PARTITION BY trade_date))
SELECT code_id, trade_date, CASE WHEN s11 * s22 - s12 * s12 > 1e-3 THEN {six('y - ((s1y * s22 - s2y * s12) * c1 + (s2y * s11 - s1y * s12) * c2) / (s11 * s22 - s12 * s12)')} END AS res FROM s""")
def _(t):
    p = t.panel.withColumn("lmv", F.when(F.col("mv") > 0, F.log(F.when(F.col("mv") > 0, F.col("mv")))))
    out = ops.neutralize_multi(p, "momentum", ["lmv", "volume"], out="res")
    # dates without spread in the covariates have no solution
    from pyspark.sql import Window

    w, i = Window.partitionBy("trade_date"), Window.partitionBy("trade_date", "industry")
    ok = F.col("momentum").isNotNull() & F.col("lmv").isNotNull()
    out = out.withColumn("__a", F.when(ok, F.col("lmv"))).withColumn("__b", F.when(ok, F.col("volume")))
    out = out.withColumns({"__a": F.col("__a") - F.avg("__a").over(i), "__b": F.col("__b") - F.avg("__b").over(i)})
    det = F.sum(F.col("__a") * F.col("__a")).over(w) * F.sum(F.col("__b") * F.col("__b")).over(w) - F.pow(F.sum(F.col("__a") * F.col("__b")).over(w), 2)
    return out.withColumn("__det", det).select("code_id", "trade_date", F.when(F.col("__det") > 1e-3, r6("res")).alias("res"))


_THREE = """WITH a AS (SELECT code_id, trade_date, industry, CASE WHEN ok THEN momentum END AS y, CASE WHEN ok THEN ln(mv) END AS p, CASE WHEN ok THEN volume / 100 END AS q, CASE WHEN ok THEN amount / 100000 END AS r
  FROM (SELECT *, momentum IS NOT NULL AND mv > 0 AS ok FROM panel)),
c AS (SELECT code_id, trade_date, y - avg(y) OVER i AS y, p - avg(p) OVER i AS p, q - avg(q) OVER i AS q, r - avg(r) OVER i AS r FROM a WINDOW i AS (PARTITION BY trade_date, industry)),
o AS (SELECT *, sum(p * p) OVER d AS op, sum(q * q) OVER d AS oq, sum(r * r) OVER d AS o_r FROM c WINDOW d AS (PARTITION BY trade_date)),
c1 AS (SELECT *, sum(p * y) OVER d AS py, sum(p * q) OVER d AS pq, sum(p * r) OVER d AS pr FROM o WINDOW d AS (PARTITION BY trade_date)),
c2 AS (SELECT code_id, trade_date, op, oq, o_r, CASE WHEN op > 0 THEN y - p * py / op ELSE y END AS y, CASE WHEN op > 0 THEN q - p * pq / op ELSE q END AS q, CASE WHEN op > 0 THEN r - p * pr / op ELSE r END AS r FROM c1),
c3 AS (SELECT *, sum(q * q) OVER d AS dq, sum(q * y) OVER d AS qy, sum(q * r) OVER d AS qr FROM c2 WINDOW d AS (PARTITION BY trade_date)),
c4 AS (SELECT code_id, trade_date, o_r, CASE WHEN dq > 1e-10 * oq THEN y - q * qy / dq ELSE y END AS y, CASE WHEN dq > 1e-10 * oq THEN r - q * qr / dq ELSE r END AS r FROM c3),
c5 AS (SELECT *, sum(r * r) OVER d AS dr, sum(r * y) OVER d AS ry FROM c4 WINDOW d AS (PARTITION BY trade_date))
"""


@query("neutralize_three", f"{_THREE} SELECT code_id, trade_date, {six('CASE WHEN dr > 1e-10 * o_r THEN y - r * ry / dr ELSE y END')} AS res FROM c5")
def _(t):
    p = t.panel.withColumns({"lmv": F.when(F.col("mv") > 0, F.log(F.when(F.col("mv") > 0, F.col("mv")))), "q": F.col("volume") / 100, "r": F.col("amount") / 100000})
    return ops.neutralize_multi(p, "momentum", ["lmv", "q", "r"], out="res").select("code_id", "trade_date", r6("res").alias("res"))


@query("zscore", f"SELECT code_id, trade_date, {six('z')} AS z FROM {_Z.format(src=_MOM)}")
def _(t):
    return t.panel.select("code_id", "trade_date", r6(ops.zscore("momentum")).alias("z"))


_PRE = _Z.format(src=_NEUTRAL.format(src=_CLIP))


@query("preprocess_column", f"SELECT code_id, trade_date, {six('z')} AS z FROM {_PRE}")
def _(t):
    return ops.preprocess_column(t.panel, "momentum").select("code_id", "trade_date", r6("momentum").alias("z"))


@query("preprocess_many", f"SELECT code_id, trade_date, 'momentum' AS factor, {six('z')} AS z FROM {_PRE} UNION ALL SELECT code_id, trade_date, 'volume', {six('z')} FROM {_PRE.replace('momentum', 'volume')}")
def _(t):
    return ops.preprocess_many(t.panel, ["momentum", "volume"], ["code_id", "trade_date"]).select("code_id", "trade_date", "factor", r6("value").alias("z"))


@query("factor_rank", "SELECT code_id, trade_date, CASE WHEN momentum IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY momentum DESC NULLS LAST) END AS momentum_rank FROM panel")
def _(t):
    return ops.factor_rank(t.panel, "momentum", ascending=False).select("code_id", "trade_date", "momentum_rank")


_SCORE = """(SELECT *, CASE WHEN momentum IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY momentum DESC NULLS LAST) END * CAST(0.75 AS DOUBLE) + CASE WHEN mv IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY mv ASC NULLS LAST) END * CAST(0.25 AS DOUBLE) AS score FROM panel)"""


@query("composite_score", f"SELECT code_id, trade_date, score FROM {_SCORE}")
def _(t):
    return ops.composite_score(t.panel, [("momentum", False, 1.5), ("mv", True, 0.5)]).select("code_id", "trade_date", "score")


@query("range_filter", """WITH a AS (SELECT *, CASE WHEN momentum IS NOT NULL THEN rank() OVER (PARTITION BY trade_date ORDER BY momentum NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, momentum) - 1) / 2.0 END AS r, count(momentum) OVER (PARTITION BY trade_date) AS n FROM panel),
b AS (SELECT * FROM a WHERE r / n <= 0.5), c AS (SELECT *, rank() OVER (PARTITION BY trade_date ORDER BY industry DESC) + (count(*) OVER (PARTITION BY trade_date, industry) - 1) / 2.0 AS ri FROM b)
SELECT code_id, trade_date FROM c WHERE ri <= 20 AND volume > 100""")
def _(t):
    return ops.range_filter(t.panel, [("momentum", "pct:<=0.5"), ("industry", "rank:<=20", False), ("volume", "val:>100")]).select("code_id", "trade_date")


@query("name_filter", f"SELECT code_id, trade_date, name FROM {_FLAGS} WHERE NOT regexp_matches(name, 'S|\\*|退') AND listed_days > 250")
def _(t):
    return ops.name_filter(_flags(t)).select("code_id", "trade_date", "name")


_LATE = "(SELECT code_id, trade_date, momentum, next_return, volume FROM panel)"


@query("drop_blank_dates", f"""WITH d AS (SELECT trade_date, count(next_return) AS a, count(momentum) AS b FROM {_LATE} GROUP BY trade_date), r AS (SELECT * FROM d ORDER BY trade_date DESC LIMIT 5)
SELECT code_id, trade_date, momentum FROM {_LATE} WHERE trade_date NOT IN (SELECT trade_date FROM r WHERE a = 0 OR b = 0)""")
def _(t):
    return ops.drop_blank_dates(t.panel, ["next_return", "momentum"]).select("code_id", "trade_date", "momentum")


@query("latest_full_date", "SELECT max(trade_date) AS trade_date FROM (SELECT trade_date FROM panel GROUP BY trade_date HAVING count(next_return) > 0 AND count(momentum) > 0)")
def _(t):
    return ops.latest_full_date(t.panel, ["next_return", "momentum"])


@query("excess_return", f"SELECT code_id, trade_date, {six('next_return - avg(next_return) OVER (PARTITION BY trade_date)')} AS excess FROM panel")
def _(t):
    return t.panel.select("code_id", "trade_date", r6(ops.excess_return()).alias("excess"))


@query("cross_factor", f"SELECT code_id, trade_date, {six('momentum - avg(momentum) OVER (PARTITION BY trade_date, industry)')} AS rel FROM panel")
def _(t):
    from pyspark.sql import Window

    rel = F.col("momentum") - F.avg("momentum").over(Window.partitionBy("trade_date", "industry"))
    return ops.cross_factor(t.panel, "rel", r6(rel)).select("code_id", "trade_date", "rel")
