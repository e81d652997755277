"""Reading and writing panels. Schemas are given, wanted columns that a file lacks become NULL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import clean, div

BAR_SCHEMA = "code string, name string, trade_date date, open double, high double, low double, close double, pre_close double, volume double, amount double, float_mv double, total_mv double"


def with_columns(df: DataFrame, schema: str | StructType) -> DataFrame:
    """The schema's columns, in its types; missing ones NULL, doubles free of NaN and infinity."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = []
    for f in want.fields:
        c = F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((clean(c) if f.dataType.simpleString() == "double" else c).alias(f.name))
    return df.select(*out)


def scan_bars_csv(spark: SparkSession, path: str, schema: str = BAR_SCHEMA, encoding: str = "GBK", banner: str | None = None) -> DataFrame:
    """Per-code CSV files of a folder in one scan. A banner line before the header (begins with `banner`) and repeated
    headers are dropped by filters: every file keeps its place in the parallel read."""
    want = StructType.fromDDL(schema)
    names = [f.name for f in want.fields]
    if not encoding.lower().startswith(("utf", "us-ascii", "iso-8859-1")):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    raw = spark.read.option("encoding", encoding).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    raw = raw.where(~F.col(f"`{names[0]}`").eqNullSafe(names[0]))
    if banner:
        raw = raw.where(~F.coalesce(F.col(f"`{names[0]}`").startswith(banner), F.lit(False)))
    return raw.select(*(clean(F.col(f"`{f.name}`").try_cast("double")).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in want.fields))


def scan_hour_bars(spark: SparkSession, path: str, end_time: str = "candle_end_time") -> DataFrame:
    return spark.read.parquet(path).withColumnRenamed(end_time, "trade_date")


def index_returns(index: DataFrame, start=None, end=None, warm_up: int = 0, day: str = "trade_date") -> DataFrame:
    """day, ret (first: close / open - 1), in_range. Rows from `warm_up` bars before start to end. An index is a row a
    day."""
    w = Window.orderBy(day)
    out = index.select(day, "close", (div("close", F.coalesce(F.lag("close").over(w), "open")) - 1).alias("ret"), F.row_number().over(w).alias("__n"))
    if start is not None:
        first = out.where(F.col(day) >= F.lit(start).cast("date")).agg(F.min("__n").alias("__s"))
        out = out.join(F.broadcast(first), F.lit(True)).where(F.col("__n") >= F.col("__s") - warm_up).withColumn("in_range", F.col("__n") >= F.col("__s")).drop("__s")
    else:
        out = out.withColumn("in_range", F.lit(True))
    return (out.where(F.col(day) <= F.lit(end).cast("date")) if end is not None else out).drop("__n", "close")


def any_date(*columns: str) -> Column:
    """The first alias that holds a date, as yyyyMMdd or yyyy-MM-dd; NULL if none does."""
    tries = []
    for c in columns:
        text = F.col(f"`{c}`").cast("string")
        tries += [F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))]
    return F.coalesce(*tries).cast("date")


def scan_filings(raw: DataFrame, fields: list[str], report: tuple[str, ...] = ("report_date",), publish: tuple[str, ...] = ("publish_date",), key: str = "code_id") -> DataFrame:
    """Filings with resolved date columns (aliases), fields as doubles (what isn't a number is NULL), missing fields
    NULL; rows without a date are dropped."""
    have = lambda names: [n for n in names if n in raw.columns]
    cols = [clean(F.col(f"`{f}`").cast("string").try_cast("double")).alias(f) if f in raw.columns else F.lit(None).cast("double").alias(f) for f in fields]
    out = raw.select(key, any_date(*have(report)).alias("report_date"), any_date(*have(publish)).alias("publish_date"), *cols)
    return out.where("report_date is not null and publish_date is not null")


def scan_calendar(calendar: DataFrame, periods: list[str], first, last, day: str = "trade_date") -> DataFrame:
    return calendar.select(day, *periods).where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def attach_extra_table(panel: DataFrame, extra: DataFrame | None, columns: list[str], on: tuple[str, ...] = ("trade_date", "code_id")) -> DataFrame:
    """Adds columns of an extra daily table; a missing table gives NULLs; columns that the panel has stay its own."""
    new = [c for c in columns if c not in panel.columns]
    if extra is None:
        return panel.withColumns({c: F.lit(None).cast("double") for c in new})
    return panel.join(extra.select(*on, *new), list(on), "left")


def write_panel(panel: DataFrame, path: str, factors: tuple[str, ...] = (), day: str = "trade_date", keys: tuple[str, ...] = ("trade_date", "code_id")) -> None:
    """Stores the panel by year, and each factor apart with its keys; sorted within files so that scans skip row groups."""
    base = panel.drop(*factors).withColumn("year", F.year(day))
    base.repartition("year", keys[-1]).sortWithinPartitions(keys[-1], day).write.partitionBy("year").mode("overwrite").parquet(f"{path}/panel")
    for f in factors:
        panel.select(*keys, f).write.mode("overwrite").parquet(f"{path}/factor={f}")


def load_factor_slice(spark: SparkSession, path: str, columns: list[str], factors: list[str], codes: DataFrame | None = None, check: bool = False, keys: tuple[str, ...] = ("trade_date", "code_id")) -> DataFrame:
    """Panel columns with factors, for a set of codes. check: raises with the counts of keys that only one side has."""
    base = spark.read.parquet(f"{path}/panel").select(*keys, *[c for c in columns if c not in keys])
    for f in factors:
        table = spark.read.parquet(f"{path}/factor={f}")
        if check:
            odd = base.select(*keys, F.lit(1).alias("__l")).join(table.select(*keys, F.lit(1).alias("__r")), list(keys), "full").agg(F.count_if(F.col("__r").isNull()).alias("no_factor"), F.count_if(F.col("__l").isNull()).alias("no_row")).first()
            if odd.no_factor or odd.no_row:
                raise ValueError(f"{f} isn't aligned: {odd.no_factor} rows without a factor, {odd.no_row} factors without a row")
        base = base.join(table.select(*keys, f), list(keys), "left")
    return base.join(codes, keys[-1], "left_semi") if codes is not None else base


def write_bucketed_panel(panel: DataFrame, path: str, factors: tuple[str, ...] = (), buckets: int = 64, key: str = "code_id", day: str = "trade_date") -> None:
    """Stores the panel and each factor apart, all dealt to the same number of buckets by code and day and sorted by them, so
    that load_bucketed_slice joins them without moving a row. Each bucket is written by one task; no code makes one large."""
    spark = panel.sparkSession
    for name, columns in [("panel", [c for c in panel.columns if c not in factors]), *((f"factor_{f}", [key, day, f]) for f in factors)]:
        table = f"bucketed_{uuid.uuid4().hex}"
        rows = panel.select(*columns).repartition(buckets, key, day)
        rows.write.bucketBy(buckets, key, day).sortBy(key, day).option("path", f"{path}/{name}").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay: the table was external
    note = spark.createDataFrame([(buckets, key, day)], "buckets int, code string, day string")
    note.coalesce(1).write.mode("overwrite").json(f"{path}/layout")


def _bucketed(spark: SparkSession, path: str, layout) -> DataFrame:
    """A stored part, read as the bucketed table that it is."""
    table = f"bucketed_{uuid.uuid4().hex}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY (`{layout.code}`, `{layout.day}`) SORTED BY (`{layout.code}`, `{layout.day}`) INTO {layout.buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def load_bucketed_slice(spark: SparkSession, path: str, columns: list[str], factors: list[str], codes: list | None = None) -> DataFrame:
    """Panel columns with factors, joined bucket by bucket: no exchange. Of a list of codes only the row groups that may have
    them are read, as buckets are sorted by code."""
    layout = spark.read.json(f"{path}/layout").first()
    keys = [layout.code, layout.day]
    keep = F.col(layout.code).isin(codes) if codes is not None else F.lit(True)
    out = _bucketed(spark, f"{path}/panel", layout).where(keep).select(*keys, *[c for c in columns if c not in keys])
    for f in factors:
        out = out.join(_bucketed(spark, f"{path}/factor_{f}", layout).where(keep).hint("merge"), keys, "left")
    return out


def write_csv_report(df: DataFrame, path: str, parquet: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
    if parquet:
        df.write.mode("overwrite").parquet(f"{path}.parquet")
