"""Segmented scans against a loop."""

import random

import numpy as np

from panelfx.operators import scan


def loop(values, alpha):
    out, x = [], None
    for v in values:
        x = x if v is None else v if x is None else alpha * v + (1 - alpha) * x
        out.append(x)
    return out


def test_prefixes():
    draw = np.random.default_rng(1)
    m = scan.decay(0.3)
    v, first = draw.normal(size=500), draw.random(500) < 0.05
    first[0] = True
    got = m.result(scan.prefixes(m, m.lift(v, first), first))
    x = None
    for i in range(500):
        x = v[i] if first[i] else 0.3 * v[i] + 0.7 * x
        assert abs(got[i] - x) < 1e-12


def test_segmented_scan(spark):
    draw = random.Random(3)
    rows = [(code, day, draw.choice([None, 1.5, draw.uniform(-5, 5)]) if day % 50 else 2.0, f"t{day}") for code, n in ((1, 3000), (2, 5), (3, 1), (None, 40), (7, 900)) for day in range(n)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "code_id long, trade_date int, close double, tag string")
    for chunks in (1, 3, 16):
        out = scan.segmented_scan(df, scan.decay(0.25), "close", chunks=chunks)
        got = {(r.code_id, r.trade_date): (r.x, r.tag) for r in out.collect()}
        assert len(got) == len(rows)
        for code in (1, 2, 3, None, 7):
            own = sorted(r[1:] for r in rows if r[0] == code)
            for (day, _, tag), want in zip(own, loop([r[1] for r in own], 0.25), strict=True):
                x, t = got[code, day]
                assert t == tag and (x is None) == (want is None) and (x is None or abs(x - want) < 1e-9)
    assert scan.segmented_scan(df.limit(0), scan.decay(0.5), "close").count() == 0


def test_one_code_in_many_tasks(spark):
    df = spark.range(200_000).selectExpr("1L code_id", "id trade_date", "cast(id % 13 as double) close")
    out = scan.segmented_scan(df, scan.decay(0.1), "close", chunks=12)
    sizes = [r[0] for r in out.selectExpr("spark_partition_id() p").groupBy("p").count().select("count").collect()]
    assert len(sizes) >= 8 and max(sizes) < 60_000
    want = loop([float(i % 13) for i in range(200_000)], 0.1)[-1]
    assert abs(out.where("trade_date = 199999").first().x - want) < 1e-9
