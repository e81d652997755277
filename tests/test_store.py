"""The bucketed table: results, files touched, crashes between steps, rival writers."""

import os

import pytest
from pyspark.sql import functions as F

from panelfx.sources import store

SCHEMA = "k long, at int, v double"


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(spark, path, SCHEMA, ["k"], 16, ["at"])
    return path


def content(spark, path, version=None):
    return {r.k: (r.at, r.v) for r in store.read(spark, path, version).collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_upsert_equals_a_dictionary(spark, table):
    want = {}
    for n in range(5):
        rows = [(k, n, float(k * n)) for k in range(n * 7, n * 7 + 30)]
        store.upsert(spark, table, frame(spark, rows).withColumn("extra", F.lit(1)))
        want |= {k: (a, v) for k, a, v in rows}
        assert content(spark, table) == want
    assert content(spark, table, 1) == {k: (0, 0.0) for k in range(30)}
    store.rebucket(spark, table, 5)
    assert content(spark, table) == want and store.manifest(spark, table)["buckets"] == 5
    assert store.read(spark, table).where("k is null").count() == 0


def test_nulls_ties_and_repeated_rows(spark, table):
    store.upsert(spark, table, frame(spark, [(None, 1, 1.0), (None, 2, 2.0), (1, None, 5.0), (1, 1, None), (2, 1, 7.0), (2, 1, 7.0), (2, 1, 9.0)]))
    assert content(spark, table) == {None: (2, 2.0), 1: (1, None), 2: (1, 9.0)}
    store.upsert(spark, table, frame(spark, [(None, 0, 3.0)]))
    assert content(spark, table)[None] == (0, 3.0)
    assert store.upsert(spark, table, frame(spark, []))["touched"] == [] and len(content(spark, table)) == 3


def test_only_touched_buckets_are_read_and_written(spark, table):
    store.upsert(spark, table, frame(spark, [(k, 0, 0.0) for k in range(2000)]))
    before = store.manifest(spark, table)["files"]
    did = store.upsert(spark, table, frame(spark, [(5, 1, 1.0), (6, 1, 1.0)]))
    after = store.manifest(spark, table)["files"]
    assert len(before) == 16 and len(did["touched"]) <= 2 and did["read"] <= 2 and did["written"] <= 2
    assert {b for b in after if after[b] != before[b]} == set(map(str, did["touched"]))
    assert len(content(spark, table)) == 2000


@pytest.mark.parametrize("step", ["_write", "_put"])
def test_crash_leaves_the_old_table(spark, table, monkeypatch, step):
    store.upsert(spark, table, frame(spark, [(1, 0, 1.0)]))
    whole = getattr(store, step)

    def crash(*args):
        if step == "_write":
            whole(*args)
        raise OSError("crash")

    monkeypatch.setattr(store, step, crash)
    with pytest.raises(OSError):
        store.upsert(spark, table, frame(spark, [(1, 0, 2.0), (2, 0, 2.0)]))
    monkeypatch.undo()
    assert content(spark, table) == {1: (0, 1.0)}
    store.upsert(spark, table, frame(spark, [(1, 0, 2.0), (2, 0, 2.0)]))
    assert content(spark, table) == {1: (0, 2.0), 2: (0, 2.0)}
    assert store.vacuum(spark, table, older_than=-10) > 0
    assert content(spark, table) == {1: (0, 2.0), 2: (0, 2.0)}
    with pytest.raises(FileNotFoundError):
        store.read(spark, table, 1)


def test_rival_writers(spark, table, monkeypatch):
    whole = store._write

    def slow(*args):
        monkeypatch.setattr(store, "_write", whole)
        store.upsert(spark, table, frame(spark, [(1, 0, 10.0)]))  # another writer in between
        return whole(*args)

    monkeypatch.setattr(store, "_write", slow)
    with pytest.raises(store.Conflict):
        store.upsert(spark, table, frame(spark, [(1, 0, 20.0)]))
    assert content(spark, table) == {1: (0, 10.0)}
    assert not [f for f in os.listdir(f"{table}/manifest") if f.startswith(".") and not f.endswith(".crc")]


def test_batches_count_once(spark, table):
    for batch in (0, 1, 1, 0):
        store.upsert(spark, table, frame(spark, [(1, batch, float(batch))]), "w", batch)
    assert content(spark, table) == {1: (1, 1.0)} and store.manifest(spark, table)["version"] == 2
