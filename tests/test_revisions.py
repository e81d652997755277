"""The sweep over revisions against snapshots of everything known at each publish date."""

import random

import pytest
from pyspark.sql import functions as F

from panelfx.operators import filings, revisions
from panelfx.operators.filings import fin_qoq, fin_yoy, view_quarter, view_ttm


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(6)
    rows = []
    for code in range(4):
        for n in range(16):
            if draw.random() < 0.85:
                end = f"{2018 + n // 4}-{(n % 4 + 1) * 3:02d}-28"
                first = (n + 1) * 91 + draw.randint(5, 100)
                for late in (0, *(draw.randint(1, 500) for _ in range(draw.choice([0, 0, 1, 2])))):
                    rows.append((code, end, first + late, *(draw.choice([None, float(draw.randint(-5, 20))]) for _ in range(2))))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "code_id long, report_date string, d int, r_a double, b_c double")
    return df.select("code_id", F.to_date("report_date").alias("report_date"), F.expr("date_add(date'2018-01-01', d)").alias("publish_date"), "r_a", "b_c")


def test_views_equal_snapshots(spark, table):
    wanted = [f"r_a_{v}" for v in revisions.VIEWS if v != "raw"] + ["b_c_yoy", "b_c_qoq", "b_c"]
    days = table.select("code_id").distinct().crossJoin(spark.range(80).selectExpr("date_add(date'2018-03-01', cast(id * 20 as int)) trade_date"))
    got = {(r.code_id, r.trade_date): r for r in revisions.fin_columns(table, days, wanted).collect()}
    snap = filings.asof_snapshots(table, ["r_a", "b_c"]).withColumn("rq", view_quarter("r_a"))
    snap = snap.withColumn("t", view_ttm("rq", "r_a"))
    views = {
        "r_a_annual": F.when(F.quarter("report_date") == 4, F.col("r_a")), "r_a_quarter": F.col("rq"), "r_a_ttm": F.col("t"), "r_a_yoy": fin_yoy("r_a"), "r_a_qoq": fin_qoq("r_a"),
        "r_a_quarter_yoy": fin_yoy("rq"), "r_a_quarter_qoq": fin_qoq("rq"), "r_a_ttm_yoy": fin_yoy("t"), "b_c_yoy": fin_yoy("b_c"), "b_c_qoq": fin_qoq("b_c"), "b_c": F.col("b_c"),
    }
    assert set(views) == set(wanted)
    picked = filings.pick_latest_published(snap.withColumns(views), wanted)
    want = filings.align_to_trade_date(days, picked, wanted).collect()
    assert len(got) == len(want) == 320
    for r in want:
        for w in wanted:
            a, b = got[r.code_id, r.trade_date][w], r[w]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9), (w, r)


def test_rows_in_proportion_to_revisions(table):
    filed = table.select("code_id", "report_date", "publish_date").distinct().count()
    assert revisions.quarter_changes(table, ["r_a"], 4).count() <= filed * 5
    assert revisions.newest_quarter(revisions.quarter_changes(table, ["r_a"], 4)).count() <= filed
    assert revisions.quarter_changes(table.limit(0), ["r_a"], 4).count() == 0


def test_unknown_views():
    with pytest.raises(ValueError):
        filings.split_flow_stock("b_c_ttm")


def test_same_periods_come_from_the_latest_filing_and_are_carried_forward(spark, table):
    """periods of the newest quarter alone, three of six, and nothing was carried forward."""
    days = table.select("code_id").distinct().crossJoin(spark.range(80).selectExpr("date_add(date'2018-03-01', cast(id * 20 as int)) trade_date"))
    got = {(r.code_id, r.trade_date): r for r in revisions.same_period_join(days, table, "r_a").collect()}
    filed = sorted({(r.code_id, r.publish_date, r.report_date, r.r_a) for r in table.collect()}, key=lambda r: r[:3])
    assert len({r[:3] for r in filed}) == len(filed) and len(got) == 320
    carried = late = 0
    for code in range(4):
        own, last = [r[1:] for r in filed if r[0] == code], dict.fromkeys(revisions.PERIODS)
        q = [r.year * 4 + (r.month - 1) // 3 for _, r, _ in own]
        for _, day in sorted(k for k in got if k[0] == code):
            seen = [i for i, (p, _, _) in enumerate(own) if p <= day]
            if seen:
                at = seen[-1]
                start = q[at] // 4 * 4
                wanted = {"prev_q": q[at] - 1, "same_q": q[at] - 4, "last_fy": start - 1, "last_q1": start - 4, "last_q2": start - 3, "last_q3": start - 2}
                newest = max(seen, key=lambda i: (q[i], i))
                late += newest != at
                assert got[code, day].r_a == own[newest][2]
                for name, target in wanted.items():
                    value = next((own[i][2] for i in range(at - 1, -1, -1) if q[i] == target), None)
                    carried += value is None and last[name] is not None
                    last[name] = last[name] if value is None else value
            assert {n: got[code, day][n] for n in last} == last
    assert carried and late


def test_same_period_query_has_all_periods(spark):
    """the registered query had two of them."""
    from panelfx.plans import queries

    assert set(revisions.PERIODS) <= set(queries()["fin_same_period_join"](spark, "/root/testdata/sf0.001").columns)


def test_filed_history_equals_the_lookup(table):
    once = table.distinct()
    look = filings.filing_history_lookup(once, "r_a").select("code_id", "report_date", "publish_date", *revisions.PERIODS)
    swept = revisions.filed_history(once, ["r_a"], 7).select("code_id", "report_date", F.col("pub").alias("publish_date"), *(c("r_a").alias(n) for n, c in revisions.PERIODS.items()))
    assert sorted(map(str, swept.collect())) == sorted(map(str, look.collect()))
