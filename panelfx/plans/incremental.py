from pyspark.sql import functions as F

from ..functions import r4
from ..functions.lineage import shared_folder
from ..operators import incremental as ops
from ..operators.factors import close_std
from ..sources import store
from .registry import query, six

_STATE = "(SELECT code_id, f AS factor, CASE WHEN code_id % 7 = 1 THEN m + 30 WHEN code_id % 7 = 2 THEN m ELSE m - 100 END AS done_max, code_id % 7 <> 3 AS valid FROM (SELECT code_id, max(trade_date) AS m FROM bars_d GROUP BY 1) CROSS JOIN (VALUES ('a'), ('b')) v(f) WHERE NOT (code_id % 5 = 0 AND f = 'b'))"


def _state(t):
    s = t.bars_d.groupBy("code_id").agg(F.max("trade_date").alias("m")).withColumn("factor", F.explode(F.array(F.lit("a"), F.lit("b")))).where("not (code_id % 5 = 0 and factor = 'b')")
    done = F.when(F.col("code_id") % 7 == 1, F.date_add("m", 30)).when(F.col("code_id") % 7 == 2, F.col("m")).otherwise(F.date_sub("m", 100))
    return s.select("code_id", "factor", done.alias("done_max"), (F.col("code_id") % 7 != 3).alias("valid"))


def _source(t):
    return t.bars_d.groupBy("code_id").agg(F.max("trade_date").alias("source_max"))


@query("incremental_plan", f"""WITH w AS (SELECT code_id, m, f FROM (SELECT code_id, max(trade_date) AS m FROM bars_d GROUP BY 1) CROSS JOIN (VALUES ('a'), ('b')) v(f)),
a AS (SELECT w.code_id, w.f AS factor, done_max, CASE WHEN done_max IS NULL OR NOT coalesce(valid, FALSE) OR m < done_max THEN 'full' WHEN m <= done_max THEN 'skip' ELSE 'incremental' END AS action FROM w LEFT JOIN {_STATE} s ON w.code_id = s.code_id AND w.f = s.factor)
SELECT code_id, factor, action, CASE WHEN max(CASE WHEN action = 'full' THEN 1 ELSE 0 END) OVER c = 0 THEN min(CASE WHEN action = 'incremental' THEN done_max END) OVER c END AS cut FROM a WINDOW c AS (PARTITION BY code_id)""")
def _(t):
    return ops.incremental_plan(_state(t), _source(t), ["a", "b"])


@query("incremental_recompute", f"""SELECT code_id, trade_date, {six('x', 4)} AS x FROM (SELECT code_id, trade_date, CASE WHEN count(close) OVER f = 10 THEN stddev_samp(close) OVER f END AS x FROM bars_d WINDOW f AS (PARTITION BY code_id ORDER BY trade_date ROWS 9 PRECEDING)) WHERE trade_date > DATE '1997-06-30' OR code_id % 4 = 0""")
def _(t):
    """Equal to the full computation after the cut."""
    cuts = t.bars_d.select("code_id").distinct().withColumn("cut", F.when(F.col("code_id") % 4 != 0, F.lit("1997-06-30").cast("date")))
    out = ops.incremental_recompute(t.bars_d, cuts, 9, lambda d: d.withColumn("x", close_std(10)))
    return out.select("code_id", "trade_date", r4("x").alias("x"))


@query("upsert_keep_last", "SELECT code_id, trade_date, CASE WHEN trade_date >= DATE '1997-01-01' THEN close * 2 ELSE close END AS close FROM bars_m")
def _(t):
    b = t.bars_m.select("code_id", "trade_date", "close")
    return ops.upsert_keep_last(b.where("trade_date < date'1998-01-01'"), b.where("trade_date >= date'1997-01-01'").withColumn("close", F.col("close") * 2), ["code_id", "trade_date"])


@query("definition_invalidation", f"SELECT code_id, factor FROM {_STATE} WHERE factor = 'a'")
def _(t):
    state = _state(t).withColumn("code_hash", F.sha2(F.when(F.col("factor") == "a", "close / lag").otherwise("old text"), 256))
    return ops.definition_invalidation(state, {"a": "close / lag", "b": "new text"}).select("code_id", "factor")


@query("upsert_bucketed", "SELECT code_id, trade_date, CASE WHEN trade_date >= DATE '1997-01-01' THEN close * 2 ELSE close END AS close FROM bars_m")
def _(t):
    """The same through a bucketed table: the second batch rewrites the buckets that it touches."""
    b = t.bars_m.select("code_id", "trade_date", "close")
    path = shared_folder(t.spark, "store")
    store.create(t.spark, path, b.schema, ["code_id", "trade_date"], 32)
    store.upsert(t.spark, path, b.where("trade_date < date'1998-01-01'"), "bars", 0)
    store.upsert(t.spark, path, b.where("trade_date >= date'1997-01-01'").withColumn("close", F.col("close") * 2), "bars", 1)
    return store.read(t.spark, path)


@query("hour_bars_batch", "SELECT user_id, strftime(bar_ts, '%Y-%m-%d %H:%M:%S') AS bar_ts, n, amount, high, low FROM hour_bars")
def _(t):
    """The batch form of the hourly bars of an event stream (the streaming run is compared with it in the tests)."""
    from ..streaming import hour_bar_stream

    out = hour_bar_stream(t.events)
    return out.withColumn("bar_ts", F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss"))


@query("stream_incremental", f"""SELECT code_id, trade_date, {six('x', 4)} AS x FROM (
SELECT code_id, trade_date, CASE WHEN count(close) OVER f = 5 THEN stddev_samp(close) OVER f END AS x FROM bars_m WINDOW f AS (PARTITION BY code_id ORDER BY trade_date ROWS 4 PRECEDING))""")
def _(t):
    """The streaming run over files: the bars up to 1995 but for the last two months of every other code, then, after a
    restart, the rest, the late ones among them, and a far bar of no code, which lets the last bars out."""
    from ..streaming import run_rolling

    bars = t.bars_m.select("code_id", "trade_date", "close")
    early = (F.col("trade_date") < "1996-01-01") & ~((F.col("trade_date") >= "1995-11-01") & (F.col("code_id") % 2 == 0))
    end = t.spark.range(1).select(F.lit(-1).cast(bars.schema["code_id"].dataType).alias("code_id"), F.lit("2100-01-01").cast("date").alias("trade_date"), F.lit(0.0).alias("close"))
    source, target, mark = (shared_folder(t.spark, x) for x in ("bars", "factors", "progress"))
    for part in (bars.where(early), bars.where(~early), end):
        part.write.mode("append").parquet(source)
        run_rolling(t.spark, source, bars.schema, target, mark, 5, late="70 days")
    return store.read(t.spark, target).where("code_id >= 0").select("code_id", "trade_date", r4("factor").alias("x"))
