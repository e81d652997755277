from pyspark.sql import functions as F

from ..functions import r6
from ..functions.lineage import shared_folder
from ..sources import readers as ops
from .registry import query, six


def _scratch(t) -> str:
    return shared_folder(t.spark, "panel")


@query("scan_bars", "SELECT 'c' || code_id AS code, trade_date, open, high, low, close, CAST(NULL AS DOUBLE) AS total_mv FROM bars_m")
def _(t):
    """Bars written as CSV with a banner line and a header in each file, and read back in one scan."""
    path = _scratch(t)
    b = t.bars_m.select(F.concat(F.lit("c"), "code_id").alias("code"), "trade_date", "open", "high", "low", "close", F.lit(None).cast("double").alias("total_mv"))
    text = b.select(F.concat_ws(",", "code", "trade_date", "open", "high", "low", "close", F.lit("nan")).alias("value"))
    lines = t.spark.createDataFrame([("# bars of one code",), ("code,trade_date,open,high,low,close,total_mv",)], "value string").coalesce(1)
    lines.unionByName(text).write.text(path)
    return ops.scan_bars_csv(t.spark, path, "code string, trade_date date, open double, high double, low double, close double, total_mv double", encoding="UTF-8", banner="#")


@query("scan_hour_bars", "SELECT user_id, strftime(bar_ts, '%Y-%m-%d %H:%M:%S') AS trade_date, amount FROM hour_bars")
def _(t):
    path = _scratch(t)
    t.hour_bars.withColumnRenamed("bar_ts", "candle_end_time").write.parquet(path)
    return ops.scan_hour_bars(t.spark, path).select("user_id", F.date_format("trade_date", "yyyy-MM-dd HH:mm:ss").alias("trade_date"), "amount")


_INDEX = "(SELECT trade_date, max(open) AS open, max(close) AS close FROM bars_d GROUP BY 1)"


@query("scan_index", f"""WITH r AS (SELECT trade_date, close / coalesce(lag(close) OVER (ORDER BY trade_date), open) - 1 AS ret, row_number() OVER (ORDER BY trade_date) AS n FROM {_INDEX}), s AS (SELECT min(n) AS s FROM r WHERE trade_date >= DATE '1995-01-01')
SELECT trade_date, {six('ret')} AS ret, n >= s AS in_range FROM r, s WHERE n >= s - 20 AND trade_date <= DATE '1997-12-31'""")
def _(t):
    index = t.bars_d.groupBy("trade_date").agg(F.max("open").alias("open"), F.max("close").alias("close"))
    return ops.index_returns(index, "1995-01-01", "1997-12-31", 20).select("trade_date", r6("ret").alias("ret"), "in_range")


@query("scan_filings", "SELECT code_id, report_date, publish_date, r_revenue, CAST(NULL AS DOUBLE) AS c_cash FROM filings")
def _(t):
    raw = t.filings.select("code_id", F.date_format("report_date", "yyyyMMdd").alias("end_date"), F.when(F.col("code_id") % 2 == 0, F.col("publish_date").cast("string")).alias("ann_date"), F.when(F.col("code_id") % 2 == 1, F.date_format("publish_date", "yyyyMMdd")).alias("f_ann_date"), F.coalesce(F.col("r_revenue").cast("string"), F.lit("--")).alias("r_revenue"))
    return ops.scan_filings(raw, ["r_revenue", "c_cash"], ("end_date", "report_date"), ("ann_date", "f_ann_date"))


@query("scan_calendar", "SELECT trade_date, 'W' || week(trade_date) AS w FROM calendar WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def _(t):
    return ops.scan_calendar(t.calendar.withColumns({"w": F.concat(F.lit("W"), F.weekofyear("trade_date")), "m": F.month("trade_date")}), ["w"], "1995-01-01", "1996-12-31")


@query("attach_extra_table", "SELECT b.code_id, b.trade_date, b.close, e.peak, CAST(NULL AS DOUBLE) AS absent FROM bars_m b LEFT JOIN (SELECT code_id, trade_date, high AS peak FROM bars_m WHERE volume > 100) e USING (code_id, trade_date)")
def _(t):
    extra = t.bars_m.where("volume > 100").select("code_id", "trade_date", F.col("high").alias("peak"), F.lit(0.0).alias("close"))
    out = ops.attach_extra_table(t.bars_m.select("code_id", "trade_date", "close"), extra, ["peak", "close"])
    return ops.attach_extra_table(out, None, ["absent"])


@query("write_panel", "SELECT code_id, trade_date, close, year(trade_date) AS year FROM bars_m")
def _(t):
    path = _scratch(t)
    ops.write_panel(t.bars_m.select("code_id", "trade_date", "close"), path)
    return t.spark.read.parquet(f"{path}/panel")


@query("load_factor_slice", "SELECT code_id, trade_date, close, volume * 2 AS f1, amount AS f2 FROM bars_m WHERE code_id IN (SELECT code_id FROM securities WHERE industry = 1)")
def _(t):
    path = _scratch(t)
    ops.write_panel(t.bars_m.select("code_id", "trade_date", "close", (F.col("volume") * 2).alias("f1"), F.col("amount").alias("f2")), path, ("f1", "f2"))
    return ops.load_factor_slice(t.spark, path, ["close"], ["f1", "f2"], t.securities.where("industry = 1").select("code_id"), check=True)


@query("load_bucketed_slice", "SELECT code_id, trade_date, close, volume * 2 AS f1, amount AS f2 FROM bars_m WHERE code_id % 3 > 0")
def _(t):
    path = _scratch(t)
    rows = t.bars_m.select("code_id", "trade_date", "close", (F.col("volume") * 2).alias("f1"), F.col("amount").alias("f2"))
    ops.write_bucketed_panel(rows, path, ("f1", "f2"), 8)
    return ops.load_bucketed_slice(t.spark, path, ["close"], ["f1", "f2"]).where("code_id % 3 > 0")


@query("write_csv_report", "SELECT CAST(code_id AS VARCHAR) AS code_id, CAST(count(*) AS VARCHAR) AS n FROM bars_m GROUP BY code_id")
def _(t):
    path = _scratch(t)
    ops.write_csv_report(t.bars_m.groupBy("code_id").agg(F.count("*").alias("n")), path)
    return t.spark.read.option("header", True).csv(f"{path}.csv")
