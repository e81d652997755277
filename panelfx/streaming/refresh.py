"""The incremental refresh as a continuous job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import store


def hour_bar_stream(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Hourly bars of an event stream (user_id, ts, value): event-time windows behind a watermark; later events are left
    out. user_id, bar_ts, n, amount, high, low."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).groupBy("user_id", F.window("ts", "1 hour").alias("w"))
    out = by.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"), F.max("value").alias("high"), F.min("value").alias("low"))
    return out.select("user_id", F.col("w.start").alias("bar_ts"), "n", "amount", "high", "low")


def upsert_stream(stream: DataFrame, target: str, keys: list[str], checkpoint: str, buckets: int = 16):
    """Runs what is available and keeps, for each key, the row of the latest batch (the largest by the other columns, if a
    batch has several) in a store (sources/store.py), made if there is none. A batch rewrites the buckets that it has keys
    of; a batch that runs again counts once. Read with read_latest."""
    spark = stream.sparkSession
    try:
        store.manifest(spark, target)
    except FileNotFoundError:
        store.create(spark, target, stream.schema, keys, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch.sparkSession, target, batch, checkpoint, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark, target: str) -> DataFrame:
    """The row of the latest batch of each key."""
    return store.read(spark, target)
