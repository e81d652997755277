"""The rolling stream against the batch computation: order, late bars, restarts, bars sent again."""

import datetime as dt
import json
import random
import statistics

from panelfx.sources import store
from panelfx.streaming.rolling import run_rolling

D = dt.date
SCHEMA = "code_id long, trade_date date, close double"


def test_rolling_stream(spark, tmp_path):
    draw = random.Random(2)
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    bars = {(c, d): round(draw.uniform(1, 9), 2) for c in range(6) for d in days if draw.random() < 0.8}
    first = {k: v for k, v in bars.items() if k[1] < days[40] and not (k[0] % 2 == 0 and k[1] >= days[34])}
    rest = {k: v for k, v in bars.items() if k not in first}
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    paths = [first, rest | dict(list(first.items())[-3:]), {(-1, D(2100, 1, 1)): 0.0}]
    for rows in paths:  # a restart before each
        items = [(c, d, v) for (c, d), v in rows.items()]
        draw.shuffle(items)
        spark.createDataFrame(items, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run_rolling(spark, source, SCHEMA, target, mark, 5)
    run_rolling(spark, source, SCHEMA, target, mark, 5)  # nothing new
    got = {(r.code_id, r.trade_date): r.factor for r in store.read(spark, target).where("code_id >= 0").collect()}
    assert got.keys() == bars.keys()
    for c in range(6):
        own = sorted(d for k, d in bars if k == c)
        for i, d in enumerate(own):
            want = statistics.stdev(bars[c, x] for x in own[i - 4 : i + 1]) if i >= 4 else None
            assert (got[c, d] is None) == (want is None) and (want is None or abs(got[c, d] - want) < 1e-9)


def test_bars_later_than_allowed_are_left_out(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for rows in ([(1, D(2020, 3, 1), 1.0)], [(1, D(2020, 1, 1), 2.0), (1, D(2020, 2, 27), 3.0)], [(-1, D(2100, 1, 1), 0.0)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run_rolling(spark, source, SCHEMA, target, mark, 1)
    assert sorted(r.trade_date for r in store.read(spark, target).where("code_id = 1").collect()) == [D(2020, 2, 27), D(2020, 3, 1)]


def test_state_calls_per_batch_do_not_grow_with_bars():
    """a code costs one read, one write and one timer a batch; before, each bar had a write and a timer of its own."""
    from types import SimpleNamespace

    import pandas as pd

    from panelfx.streaming.rolling import RollingFactor, sample_std

    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    handle = SimpleNamespace(getValueState=lambda *_: State(), registerTimer=lambda at: calls.append(at))
    step = RollingFactor(3, sample_std)
    step.init(handle)
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    rows = pd.DataFrame({"at": range(200, 0, -1), "value": [float(i % 7) for i in range(200, 0, -1)]})
    assert list(step.handleInputRows((1,), iter([rows[:90], rows[90:]]), clock)) == [] and calls == ["get", "update", 1]
    calls.clear()
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 150)
    (out,) = step.handleExpiredTimer((1,), clock, None)
    assert calls == ["get", "update", 151] and out["at"].tolist() == list(range(1, 151))
    want = [None, None, *(statistics.stdev(float(x % 7) for x in range(i - 2, i + 1)) for i in range(3, 151))]
    assert all((pd.isna(g) and w is None) or abs(g - w) < 1e-9 for g, w in zip(out["factor"], want, strict=True))
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 200)
    (rest,) = step.handleExpiredTimer((1,), clock, None)
    assert rest["at"].tolist() == list(range(151, 201)) and abs(rest["factor"][0] - statistics.stdev([149 % 7, 150 % 7, 151 % 7])) < 1e-9
    assert list(step.handleExpiredTimer((1,), clock, None)) == []


def test_state_does_not_grow_in_an_executor_with_the_sessions_shuffles(spark, tmp_path):
    """each shuffle partition of a session for large tables had a RocksDB store, all of them open after their tasks."""
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(30)]
    spark.createDataFrame([(c, d, float(c + i % 3)) for c in range(8) for i, d in enumerate(days)], SCHEMA).coalesce(1).write.parquet(source)
    large = spark.newSession()
    large.conf.set("spark.sql.shuffle.partitions", "64")
    stores = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.streaming.state, "StateStore$"), "MODULE$")
    held = stores.getClass().getDeclaredField("loadedProviders")
    held.setAccessible(True)
    before = set(held.get(stores).keySet().mkString("\n").split("\n"))
    run_rolling(large, source, SCHEMA, target, mark, 3)
    assert set(held.get(stores).keySet().mkString("\n").split("\n")) <= before | {""}  # none stays open
    conf = json.loads((tmp_path / "cp" / "offsets" / "0").read_text().splitlines()[1])["conf"]
    assert int(conf["spark.sql.shuffle.partitions"]) == spark.sparkContext.defaultParallelism < 64
    assert store.read(spark, target).where("trade_date < date'2020-01-20'").count() == 8 * 19


def test_state_partitions_follow_the_bars(spark, tmp_path, monkeypatch):
    from panelfx.functions import lineage
    from panelfx.streaming.rolling import state_partitions

    spark.range(2000).coalesce(1).write.parquet(str(tmp_path / "in"))
    large = spark.newSession()
    large.conf.set("spark.sql.shuffle.partitions", "64")
    monkeypatch.setattr(lineage, "SHARE", lineage.file_bytes(spark, str(tmp_path / "in")) // 4)
    assert 16 <= state_partitions(large, str(tmp_path / "in")) <= 20
    monkeypatch.setattr(lineage, "SHARE", 1)
    assert state_partitions(large, str(tmp_path / "in")) == 64
