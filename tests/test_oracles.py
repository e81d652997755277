"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from panelfx.plans import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()
SLOW = {"rolling_train_predict", "model_importance"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time(0) else v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_matches_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    res = duck.execute(oracles()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracles()) - SLOW))
def test_runs(spark, name):
    assert queries()[name](spark, SF).schema.fields
    queries()[name](spark, SF).count()
