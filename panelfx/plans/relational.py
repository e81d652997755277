from pyspark.sql import functions as F

from ..functions import r2, r4, r6
from ..operators import relational as ops
from .registry import query, six


@query("agg_group", f"SELECT code_id, {six('avg(close)', 4)} AS mean, {six('sum(close)', 2)} AS sum, count(close) AS n, {six('stddev_samp(close)', 4)} AS std, min(close) AS min, max(close) AS max, arg_min(close, trade_date) AS first, arg_max(close, trade_date) AS last, count(DISTINCT close) AS nunique FROM bars_d GROUP BY 1")
def _(t):
    out = ops.agg_group(t.bars_d, ["code_id"], "close", "trade_date")
    return out.select("code_id", r4("mean").alias("mean"), r2("sum").alias("sum"), "n", r4("std").alias("std"), "min", "max", "first", "last", "nunique")


@query("distinct_keep_last", "SELECT code_id, report_date, publish_date, b_inventory FROM filings QUALIFY row_number() OVER (PARTITION BY code_id, report_date ORDER BY publish_date DESC) = 1")
def _(t):
    return ops.distinct_keep_last(t.filings, ["code_id", "report_date"], ["publish_date"]).select("code_id", "report_date", "publish_date", "b_inventory")


_SQL = "SELECT s.code_id AS a, f.code_id AS b, s.name, f.n FROM (SELECT * FROM securities WHERE code_id % 3 > 0) s {} JOIN (SELECT code_id, count(*) AS n FROM filings WHERE code_id % 2 = 0 GROUP BY 1) f ON s.code_id = f.code_id"


def _join(name, how):
    @query(name, _SQL.format(how.upper()))
    def _(t):
        s = t.securities.where("code_id % 3 > 0").select(F.col("code_id").alias("a"), "name")
        f = t.filings.where("code_id % 2 = 0").groupBy(F.col("code_id").alias("b")).agg(F.count("*").alias("n"))
        return s.join(f, F.col("a") == F.col("b"), how)


for _n, _h in (("join_left", "left"), ("join_inner", "inner"), ("join_outer", "full"), ("join_right", "right")):
    _join(_n, _h)


@query("sort_rows", "SELECT code_id, trade_date, close FROM bars_d ORDER BY trade_date, code_id")
def _(t):
    return t.bars_d.select("code_id", "trade_date", "close").orderBy("trade_date", "code_id")


@query("top_k", "SELECT code_id, trade_date, amount FROM bars_d QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY amount DESC, code_id) <= 3")
def _(t):
    return ops.top_k(t.bars_d, ["trade_date"], [F.desc("amount"), F.asc("code_id")], 3).select("code_id", "trade_date", "amount")


@query("top_k_global", "SELECT code_id, trade_date, amount FROM bars_d ORDER BY amount DESC, code_id, trade_date LIMIT 50")
def _(t):
    return t.bars_d.select("code_id", "trade_date", "amount").orderBy(F.desc("amount"), "code_id", "trade_date").limit(50)


@query("union_all", "SELECT code_id, trade_date FROM bars_m UNION ALL SELECT code_id, publish_date FROM filings")
def _(t):
    return t.bars_m.select("code_id", "trade_date").unionByName(t.filings.select("code_id", F.col("publish_date").alias("trade_date")))


@query("set_difference", "SELECT code_id, trade_date FROM bars_d EXCEPT SELECT code_id, publish_date FROM filings")
def _(t):
    return t.bars_d.select("code_id", "trade_date").subtract(t.filings.select("code_id", "publish_date"))


@query("intersect_keys", "SELECT code_id, trade_date FROM bars_d INTERSECT SELECT code_id, publish_date FROM filings")
def _(t):
    return t.bars_d.select("code_id", "trade_date").intersect(t.filings.select("code_id", "publish_date"))


@query("concat_tables", "SELECT code_id, trade_date, close, NULL::DOUBLE AS b_inventory FROM bars_m UNION ALL SELECT code_id, publish_date, NULL, b_inventory FROM filings")
def _(t):
    return ops.concat_tables(t.bars_m.select("code_id", "trade_date", "close"), None, t.filings.select("code_id", F.col("publish_date").alias("trade_date"), "b_inventory"))


@query("pivot", "SELECT year(trade_date) AS y, " + ", ".join(f"count(*) FILTER (quarter(trade_date) = {q}) AS q{q}" for q in (1, 2, 3, 4)) + " FROM bars_d GROUP BY 1")
def _(t):
    return t.bars_d.select(F.year("trade_date").alias("y"), F.quarter("trade_date").alias("q")).groupBy("y").pivot("q", [1, 2, 3, 4]).agg(F.count(F.lit(1))).toDF("y", "q1", "q2", "q3", "q4")


@query("unpivot", "SELECT code_id, trade_date, field, value FROM (SELECT code_id, trade_date, open, high, low, close FROM bars_m) UNPIVOT (value FOR field IN (open, high, low, close))")
def _(t):
    return t.bars_m.unpivot(["code_id", "trade_date"], ["open", "high", "low", "close"], "field", "value")


@query("string_ops", "SELECT code, contains(name, 'ST') AS st, starts_with(code, 'sh') AS sh, replace(name, ' ', '') AS plain, regexp_matches(code, '^s[hz]') AS main, concat_ws('-', code, name) AS both_names, lpad(CAST(code_id AS VARCHAR), 6, '0') AS padded FROM securities")
def _(t):
    return t.securities.select(
        "code", F.col("name").contains("ST").alias("st"), F.col("code").startswith("sh").alias("sh"), F.replace("name", F.lit(" "), F.lit("")).alias("plain"), F.col("code").rlike("^s[hz]").alias("main"), F.concat_ws("-", "code", "name").alias("both_names"), F.lpad(F.col("code_id").cast("string"), 6, "0").alias("padded"),
    )


@query("date_ops", "SELECT code_id, publish_date, year(publish_date) AS y, quarter(publish_date) AS q, month(publish_date) AS m, CAST(publish_date + INTERVAL 2 MONTH AS DATE) AS later, publish_date - report_date AS days, CAST(date_trunc('month', publish_date) AS DATE) AS month0, CAST(strptime(strftime(report_date, '%Y%m%d'), '%Y%m%d') AS DATE) AS parsed FROM filings")
def _(t):
    return t.filings.select(
        "code_id", "publish_date", F.year("publish_date").alias("y"), F.quarter("publish_date").alias("q"), F.month("publish_date").alias("m"), F.add_months("publish_date", 2).alias("later"), F.datediff("publish_date", "report_date").alias("days"), F.trunc("publish_date", "month").alias("month0"),
        F.to_date(F.date_format("report_date", "yyyyMMdd"), "yyyyMMdd").alias("parsed"),
    )


@query("math_ops", f"SELECT code_id, trade_date, {six('ln(close)')} AS ln, {six('sqrt(amount)', 4)} AS sqrt, {six('pow(close, 0.3)')} AS pow, abs(open - close) AS abs, ceil(close) AS ceil, floor(close) AS floor, greatest(least(close, 1500), 1000) AS clip, {six('log10(amount)')} AS log10 FROM bars_d")
def _(t):
    from ..functions import cap

    return t.bars_d.select(
        "code_id", "trade_date", r6(F.log("close")).alias("ln"), r4(F.sqrt("amount")).alias("sqrt"), r6(F.pow("close", F.lit(0.3))).alias("pow"), F.abs(F.col("open") - F.col("close")).alias("abs"), F.ceil("close").alias("ceil"), F.floor("close").alias("floor"), cap("close", F.lit(1000.0), F.lit(1500.0)).alias("clip"), r6(F.log10("amount")).alias("log10"),
    )


@query("array_ops", "WITH a AS (SELECT code_id, list_sort(list(DISTINCT quarter(report_date))) AS qs FROM filings GROUP BY 1) SELECT code_id, unnest(list_sort(list_distinct(list_concat(qs, [4, 5])))) AS q, len(qs) AS n FROM a")
def _(t):
    a = t.filings.groupBy("code_id").agg(F.sort_array(F.collect_set(F.quarter("report_date"))).alias("qs"))
    return a.select("code_id", F.explode(F.sort_array(F.array_union("qs", F.array(F.lit(4), F.lit(5))))).alias("q"), F.size("qs").alias("n"))
