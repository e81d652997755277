from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import r6
from ..operators import plugins as ops
from ..operators.factors import momentum
from .registry import query, six

plugins = ops.Plugins()
plugins.factor("mom", ("close",))(momentum)


@plugins.factor("rel_volume", ("volume",), cross=True)
def _rel_volume(_):
    return F.col("volume") / F.avg("volume").over(Window.partitionBy("trade_date"))


@plugins.rule("liquid")
def _liquid(df):
    return df.where(F.col("volume") > 100)


@plugins.signal("above_mean")
def _above(n, w=None):
    return F.when(F.col("close") > F.avg("close").over(Window.partitionBy("code_id").orderBy("trade_date").rowsBetween(-(n - 1), 0)), 1.0).otherwise(0.0)


@plugins.source("volumes")
def _volumes(t):
    return t.bars_d.groupBy("code_id", F.trunc("trade_date", "month").alias("trade_date")).agg(F.max("volume").alias("peak"))


@query("factor_plugin", f"SELECT code_id, trade_date, {six('close / nullif(lag(close, 6) OVER (PARTITION BY code_id ORDER BY trade_date), 0) - 1')} AS mom_6, {six('volume / avg(volume) OVER (PARTITION BY trade_date)')} AS rel_volume FROM bars_m")
def _(t):
    out = plugins.add_factors(t.bars_m, [("mom", 6), ("rel_volume", None)])
    return out.select("code_id", "trade_date", r6("mom_6").alias("mom_6"), r6("rel_volume").alias("rel_volume"))


def _ewm(g):
    g = g.sort_values("trade_date")
    return g.assign(x=g["close"].ewm(alpha=0.5, adjust=False).mean())[["code_id", "trade_date", "x"]]


_DECAY = f"""WITH RECURSIVE n AS (SELECT code_id, trade_date, close, row_number() OVER (PARTITION BY code_id ORDER BY trade_date) AS k FROM bars_m), e AS (SELECT code_id, trade_date, k, close AS x FROM n WHERE k = 1 UNION ALL SELECT n.code_id, n.trade_date, n.k, 0.5 * n.close + 0.5 * e.x FROM e JOIN n ON n.code_id = e.code_id AND n.k = e.k + 1)
SELECT code_id, trade_date, {six('x', 4)} AS x FROM e"""


@query("grouped_plugin", _DECAY)
def _(t):
    from ..functions import r4

    return ops.grouped_plugin(t.bars_m.select("code_id", "trade_date", "close"), _ewm, "code_id long, trade_date date, x double").withColumn("x", r4("x"))


@query("recurrence_plugin", _DECAY.replace("0.5 * n.close + 0.5 * e.x", "n.close / 3 + e.x * 2 / 3").replace(six("x", 4), six("x")))
def _(t):
    """A decay as a segmented scan: a code's history is spread over tasks."""
    from ..operators.scan import decay, segmented_scan

    return segmented_scan(t.bars_m.select("code_id", "trade_date", "close"), decay(1 / 3), "close").select("code_id", "trade_date", r6("x").alias("x"))


@query("rule_plugin", "SELECT code_id, trade_date FROM bars_m WHERE volume > 100")
def _(t):
    return plugins.apply_rules(t.bars_m, ["liquid"]).select("code_id", "trade_date")


@query("signal_plugin", "SELECT code_id, trade_date, CASE WHEN close > avg(close) OVER (PARTITION BY code_id ORDER BY trade_date ROWS 4 PRECEDING) THEN 1.0 ELSE 0.0 END AS signal FROM bars_m")
def _(t):
    return t.bars_m.select("code_id", "trade_date", plugins.signals["above_mean"](5).alias("signal"))


@query("source_plugin", "SELECT m.code_id, m.trade_date, p.peak FROM bars_m m LEFT JOIN (SELECT code_id, CAST(date_trunc('month', trade_date) AS DATE) AS trade_date, max(volume) AS peak FROM bars_d GROUP BY 1, 2) p ON m.code_id = p.code_id AND m.trade_date = p.trade_date")
def _(t):
    from ..operators.joins import factor_attach

    return factor_attach(t.bars_m, plugins.sources["volumes"](t)).select("code_id", "trade_date", "peak")


@query("column_naming", """SELECT code_id, trade_date, concat_ws('_', factor, CASE WHEN param > 0 THEN CAST(param AS VARCHAR) END, CASE WHEN minute <> '' THEN minute END, CASE WHEN field <> '' THEN '(' || field || ')' END) AS name
FROM (SELECT code_id, trade_date, CASE code_id % 3 WHEN 0 THEN 'mom' WHEN 1 THEN 'std' ELSE 'cap' END AS factor, CAST(month(trade_date) - 1 AS INTEGER) AS param, CASE WHEN month(trade_date) % 2 = 0 THEN '0935' ELSE '' END AS minute,
 CASE WHEN code_id % 2 = 0 THEN 'close' ELSE '' END AS field FROM bars_m)""")
def _(t):
    """Names of factor settings, a row each: factor, parameter, minute and inner field, any of which may be empty."""
    settings = t.bars_m.select(
        "code_id", "trade_date", F.element_at(F.array(F.lit("mom"), F.lit("std"), F.lit("cap")), (F.col("code_id") % 3 + 1).cast("int")).alias("factor"), (F.month("trade_date") - 1).alias("param"),
        F.when(F.month("trade_date") % 2 == 0, "0935").otherwise("").alias("minute"), F.when(F.col("code_id") % 2 == 0, "close").otherwise("").alias("field"),
    )
    return settings.select("code_id", "trade_date", ops.setting_name("factor", "param", "minute", "field").alias("name"))
