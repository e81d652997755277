"""Rolling factors of each code as a stream: keyed state, and timers that wait for late bars."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.storagelevel import StorageLevel

from ..functions import lineage
from ..sources import store

#: State is kept in RocksDB. A store takes some MB outside the heap for as long as it is open, however little it holds, so
#: stores are closed with their task, and those of an executor share one bounded cache.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


class RollingFactor(StatefulProcessor):
    """Holds a code's bars that the watermark hasn't passed, and the last n - 1 values before them. A code has one timer, for
    the earliest bar that waits; when it fires no earlier bar can come any more, and all bars that the watermark has passed
    come out in order of time, so each sees its true predecessors. State is one value: a batch reads and writes it once a
    code, however many bars it brings."""

    def __init__(self, n: int, fn: Callable[[list[float]], float | None]):
        self.n, self.fn = n, fn

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bars", "at array<long>, value array<double>, last array<double>")

    def _held(self) -> tuple[list[int], list[float], list[float]]:
        held = self.state.get()
        return ([], [], []) if held is None else tuple(list(x) for x in held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs()
        at, value, last = self._held()
        first, waiting = at[0] if at else None, dict(zip(at, value, strict=True))
        for part in rows:  # a bar sent again replaces itself; one later than allowed is left out
            waiting.update((a, v) for a, v in zip(part["at"].tolist(), part["value"].tolist(), strict=True) if a > mark)
        if waiting:
            order = sorted(waiting)
            self.state.update((order, [waiting[a] for a in order], last))
            if order[0] != first:
                self.handle.registerTimer(order[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        mark = timerValues.getCurrentWatermarkInMs()
        at, value, last = self._held()
        due = sum(a <= mark for a in at)
        if not due:
            return iter(())
        values, known = last + value[:due], len(last)
        factors = [self.fn(values[i - self.n + 1 : i + 1]) if i >= self.n - 1 else None for i in range(known, known + due)]
        self.state.update((at[due:], value[due:], values[max(len(values) - self.n + 1, 0) :]))
        if due < len(at):
            self.handle.registerTimer(at[due])
        return iter([pd.DataFrame({"code_id": [key[0]] * due, "at": at[:due], "factor": pd.Series(factors, dtype="float64")})])

    def close(self) -> None:
        pass


def sample_std(values: list[float]) -> float | None:
    mean = sum(values) / len(values)
    return (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else None


def rolling_stream(bars: DataFrame, n: int, fn: Callable[[list[float]], float | None] = sample_std, value: str = "close", day: str = "trade_date", late: str = "10 days") -> DataFrame:
    """code_id, trade_date, factor of a stream of bars (code_id, a date, a value that isn't null): fn over the values of the
    last n bars of the code, NULL until there are n. A bar comes out once it is `late` behind the newest one; bars that are
    sent again before that replace themselves, later ones are left out."""
    ts = F.col(day).cast("timestamp")
    keyed = bars.where(F.col(value).isNotNull()).select("code_id", ts.alias("ts"), F.unix_millis(ts).alias("at"), F.col(value).cast("double").alias("value"))
    out = (
        keyed.withWatermark("ts", late).groupBy("code_id")
        .transformWithStateInPandas(RollingFactor(n, fn), "code_id long, at long, factor double", "Append", "EventTime")
    )
    return out.select("code_id", F.to_date(F.timestamp_millis("at")).alias(day), "factor")


def state_partitions(spark: SparkSession, source: str) -> int:
    """Partitions of the state over the bars in `source`: four for each lineage.SHARE bytes of them, as more are to come, the
    same number for each core, and no more than the session's shuffles have, whose number may follow much larger tables.
    Each costs a store a batch."""
    cores, wanted = spark.sparkContext.defaultParallelism, 4 * lineage.file_bytes(spark, source) / lineage.SHARE
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, math.ceil(wanted / cores)) * cores)


def run_rolling(spark: SparkSession, source: str, schema, target: str, checkpoint: str, n: int, late: str = "10 days", writer: str = "rolling") -> None:
    """Runs the stream over what is in the folder `source` and adds its factors to the store at `target` (made if there is
    none), a batch at a time; a batch that runs again counts once. The settings of the state stay with a session of its
    own; the first run fixes the number of its partitions."""
    own = spark.newSession()
    parts = state_partitions(spark, source)
    for name, value in {**STATE, "spark.sql.shuffle.partitions": str(parts), "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(name, value)
    try:
        store.manifest(own, target)
    except FileNotFoundError:  # a task of an upsert writes a bucket, so buckets follow the bars too
        store.create(own, target, "code_id long, trade_date date, factor double", ["code_id", "trade_date"], max(16, parts))
    stream = rolling_stream(own.readStream.schema(schema).parquet(source), n, late=late)

    def add(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist(StorageLevel.DISK_ONLY)  # the upsert reads a batch more than once; the state's step runs once
        try:
            store.upsert(batch.sparkSession, target, held, writer, batch_id)
        finally:
            held.unpersist()

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
