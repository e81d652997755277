"""Recurrences over long histories as a segmented parallel scan.

A recurrence whose steps compose (a monoid: a decay step is x -> a x + b, and two steps make one) needs no history in one
group. Rows are dealt by ranges of (key, time) into chunks; each chunk is folded to one element; the elements before a
chunk within its key make its carry; each chunk is then scanned from its carry. Only the first key of a chunk can have begun
before it, so there is at most one carry a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.lineage import checkpointed

Element = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Monoid:
    """lift(values, first): the rows' elements (arrays), first marks each key's first row with a value; combine(earlier, later):
    elementwise and associative; identity; result(elements): the value after each row."""

    lift: Callable[[np.ndarray, np.ndarray], Element]
    combine: Callable[[Element, Element], Element]
    identity: tuple[float, ...]
    result: Callable[[Element], np.ndarray]


def decay(alpha: float) -> Monoid:
    """x = alpha * value + (1 - alpha) * x before; the first value begins (NaN before it); a missing one changes nothing."""

    def lift(v: np.ndarray, first: np.ndarray) -> Element:
        gone = np.isnan(v)
        a = np.where(gone, 1.0, np.where(first, 0.0, 1 - alpha))
        return a, np.where(gone, 0.0, np.where(first, v, alpha * v)), (~gone).astype(float)

    def combine(p: Element, q: Element) -> Element:
        return p[0] * q[0], q[0] * p[1] + q[1], np.maximum(p[2], q[2])

    return Monoid(lift, combine, (1.0, 0.0, 0.0), lambda e: np.where(e[2] > 0, e[1], np.nan))


def prefixes(m: Monoid, e: Element, first: np.ndarray) -> Element:
    """The elements' inclusive scan, begun anew where first is set: in a number of vectorised steps logarithmic in the
    longest run."""
    n = len(first)
    run = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    step, out = 1, tuple(np.array(x, float) for x in e)
    while n and step <= run.max():
        at = np.flatnonzero(run >= step)
        joined = m.combine(tuple(x[at - step] for x in out), tuple(x[at] for x in out))
        out = tuple(x.copy() for x in out)
        for x, y in zip(out, joined, strict=True):
            x[at] = y
        step *= 2
    return out


def _scanned(m: Monoid, batches, opening) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Element]]:
    """Each batch (key, begins, value, ...) with its rows' scans; opening: the element before the first row."""
    carry, before = opening, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.array(batch.column(0).to_pylist(), object)
        begins = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        value = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        new = np.concatenate([[before is not None and key[0] != before[0]], key[1:] != key[:-1]])
        first = new.copy()
        first[0] = True
        e = prefixes(m, m.lift(value, begins), first)
        own = np.cumsum(new) == 0  # rows that go on with the key before
        if carry is not None and own.any():
            joined = m.combine(tuple(np.full(own.sum(), c) for c in carry), tuple(x[own] for x in e))
            for x, y in zip(e, joined, strict=True):
                x[own] = y
        yield batch, key, e
        carry, before = tuple(float(x[-1]) for x in e), (key[-1],)


def segmented_scan(df: DataFrame, m: Monoid, value: str, key: str = "code_id", order: str = "trade_date", out: str = "x", chunks: int | None = None) -> DataFrame:
    """df with a column `out`: the recurrence over each key's rows in order. A key of any length is spread over chunks (as
    many as shuffle partitions, unless given); rows of one key and time go by value. No group of a key's history is made."""
    spark = df.sparkSession
    parts = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct(order, F.col(value).cast("double").alias("v"))).alias("__s"))
    here = F.struct(F.col(order), F.col(value).cast("double").alias("v"))
    rows = df.join(start.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    rows = rows.withColumn("__b", F.coalesce(here == F.col("__s"), F.lit(False))).drop("__s")
    dealt = rows.repartitionByRange(parts, key, order, value).sortWithinPartitions(key, order, value)
    held = checkpointed(dealt.withColumn("__c", F.spark_partition_id()))
    fields = [f"e{i}" for i in range(len(m.identity))]
    kind, key_type = held.schema[key].dataType.simpleString(), to_arrow_type(held.schema[key].dataType)

    def fold(batches):
        total: dict = {}
        chunk = None
        for batch, keys, e in _scanned(m, batches, None):
            chunk = batch.column(3)[0].as_py()
            last = np.append(keys[1:] != keys[:-1], True)
            for i in np.flatnonzero(last).tolist():
                total.pop(keys[i], None)
                total[keys[i]] = tuple(float(x[i]) for x in e)
            for k in list(total)[1:-1]:
                del total[k]  # only a chunk's first and last key go on in others
        for n, (k, e) in enumerate(total.items()):
            columns = [pa.array([chunk], pa.int32()), pa.array([n == 0]), pa.array([k], key_type), *(pa.array([x]) for x in e)]
            yield pa.RecordBatch.from_arrays(columns, ["chunk", "leads", "key", *fields])

    narrow = held.select(key, "__b", F.col(value).cast("double").alias("__v"), "__c")
    ends = narrow.mapInArrow(fold, f"chunk int, leads boolean, key {kind}, " + ", ".join(f"{f} double" for f in fields))
    carries: dict[int, tuple[float, ...]] = {}
    run: tuple | None = None  # the key that the chunks before ended with, and its element
    for r in sorted(ends.collect(), key=lambda r: (r.chunk, not r.leads)):  # two rows a chunk at most
        e = tuple(r[f] for f in fields)
        if r.leads and run is not None and run[0] == r.key:
            carries[r.chunk] = run[1]
            e = tuple(float(x[0]) for x in m.combine(tuple(np.array([x]) for x in run[1]), tuple(np.array([x]) for x in e)))
        run = (r.key, e)
    names = df.columns

    def scan(batches):
        def opened():
            batches_ = iter(batches)
            head = next((b for b in batches_ if b.num_rows), None)
            if head is None:
                return
            chunk = head.column(3)[0].as_py()

            def all_():
                yield head
                yield from batches_

            yield from _scanned(m, all_(), carries.get(chunk))

        for batch, _, e in opened():
            x = m.result(e)
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(x, mask=np.isnan(x))], [*names, out])

    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    full = held.select(F.col(key).alias("__k"), "__b", F.col(value).cast("double").alias("__v"), "__c", *names)
    return full.mapInArrow(scan, schema)
