"""Small hand-made cases of the rules that are easy to get wrong."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelfx.functions import avg_rank, min_rank
from panelfx.operators import bars, cross_section, evaluate, filings, incremental, joins, plugins, portfolio, selection, staging, timing
from panelfx.sources import readers

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def panel(spark, values, day=D(2020, 1, 1)):
    return spark.createDataFrame([(day, i, v) for i, v in enumerate(values)], "trade_date date, code_id long, x double")


def test_mad_clip(spark):
    assert [r[2] for r in rows(cross_section.clip_column(panel(spark, [1.0, 2.0, 3.0, 4.0, 100.0]), "x"), "code_id")][-1] == pytest.approx(3 + 3 * 1.4826)
    assert [r[2] for r in rows(cross_section.clip_column(panel(spark, [5.0, 5.0, 5.0, 9.0]), "x"), "code_id")] == [5.0, 5.0, 5.0, 9.0]
    assert rows(cross_section.clip_column(panel(spark, [None, None]), "x"), "code_id")[0][2] is None
    assert rows(cross_section.clip_column(panel(spark, [7.0]), "x"), "code_id")[0][2] == 7.0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 1000))
def test_neutralize_is_least_squares(spark, seed):
    rng = np.random.default_rng(seed)
    n = 30
    ind, mv, y = rng.integers(0, 4, n), rng.lognormal(3, 1, n), rng.normal(size=n)
    df = spark.createDataFrame([(D(2020, 1, 1), i, float(y[i]), float(mv[i]), int(ind[i])) for i in range(n)], "trade_date date, code_id long, x double, mv double, industry int")
    got = np.array([r.x for r in cross_section.neutralize(df, "x").orderBy("code_id").collect()])
    a = np.column_stack([np.log(mv), *(ind == k for k in range(4))]).astype(float)
    assert np.allclose(got, y - a @ np.linalg.lstsq(a, y, rcond=None)[0])


def test_neutralize_edges(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1, 1.0, 5.0, 1), (D(2020, 1, 1), 2, 2.0, 0.0, 1), (D(2020, 1, 1), 3, 2.0, 4.0, None)], "trade_date date, code_id long, x double, mv double, industry int")
    assert [r.x for r in cross_section.neutralize(df, "x").collect()] == [None] * 3
    two = df.where("code_id = 1").unionByName(spark.createDataFrame([(D(2020, 1, 1), 4, 9.0, 7.0, 2)], df.schema))
    assert [round(r.x, 9) for r in cross_section.neutralize(two, "x").collect()] == [0.0, 0.0]
    assert [r.x for r in cross_section.preprocess_column(two, "x").collect()] == [None, None]


def test_neutralize_gram_is_least_squares(spark):
    rng = np.random.default_rng(1)
    data = [(D(2020, 1, d), i, *map(float, rng.normal(size=5) * [1, 1, 100, 1e-3, 1]), i % 3) for d in (1, 2) for i in range(40)]
    data.append((D(2020, 1, 1), 99, None, 1.0, 1.0, 1.0, 1.0, 1))
    data.append((D(2020, 1, 3), 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1))
    df = spark.createDataFrame(data, "trade_date date, code_id long, x double, a double, b double, c double, d double, industry int")
    df = df.withColumns({"twice": F.col("a") * 2 + F.col("industry"), "same": F.lit(4.0)})
    two = rows(cross_section.neutralize_multi(df, "x", ["a", "b"]).select("trade_date", "code_id", "x_res"), "trade_date", "code_id")
    gram = rows(cross_section.neutralize_gram(df, "x", ["a", "b"], "industry", ["trade_date"], "x_res").select("trade_date", "code_id", "x_res"), "trade_date", "code_id")
    assert all(g == t or abs(g[2] - t[2]) < 1e-9 for g, t in zip(gram, two, strict=True))
    for names in (["a", "b", "c", "d"], ["a", "twice", "same", "b", "c"]):
        out = cross_section.neutralize_multi(df, "x", names)
        got = {(r.trade_date.day, r.code_id): r.x_res for r in out.collect()}
        assert len(got) == len(data) and got[1, 99] is None and got[3, 1] == 0
        for d in (1, 2):
            part = [r for r in data if r[0].day == d and r[2] is not None]
            m = np.array([[r[3], r[4], r[5], *([r[6]] if "d" in names else []), *(float(r[7] == k) for k in range(3))] for r in part])
            y = np.array([r[2] for r in part])
            want = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
            assert np.allclose([got[d, r[1]] for r in part], want, atol=1e-9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_ranks(spark):
    df = panel(spark, [3.0, 1.0, 3.0, None])
    got = rows(df.select("code_id", min_rank("x", "trade_date"), avg_rank("x", "trade_date"), min_rank("x", "trade_date", False)), "code_id")
    assert got == [(0, 2, 2.5, 1), (1, 1, 1.0, 3), (2, 2, 2.5, 1), (3, None, None, None)]


def test_price_limits(spark):
    data = [("sh600001", "Co", D(2021, 1, 4), 10.395), ("sh688001", "ST Co", D(2021, 1, 4), 10.0), ("sz300001", "Co", D(2020, 8, 23), 10.0), ("sz300001", "Co", D(2020, 8, 24), 10.0), ("sz000001", "*ST Co", D(2021, 1, 4), 10.005), ("bj830001", "Co", D(2021, 1, 4), 10.07)]
    df = bars.price_limits(spark.createDataFrame(data, "code string, name string, trade_date date, pre_close double"))
    assert [(r.up_limit, r.down_limit) for r in df.collect()] == [(11.43, 9.36), (12.0, 8.0), (11.0, 9.0), (12.0, 8.0), (10.51, 9.5), (13.09, 7.05)]


def test_run_length_panel_against_the_grid(spark):
    import random

    draw = random.Random(1)
    days = [D(2020, 1, d) for d in range(1, 29) if d % 7]
    data = []
    for code in range(5):
        for d in days:
            if draw.random() < 0.5:
                data.append((d, code, *(draw.choice([None, float(draw.randint(1, 9))]) for _ in range(6)), draw.choice(["Y", None])))
    columns = "trade_date date, code_id long, open double, high double, low double, close double, pre_close double, volume double, m string"
    df, cal = spark.createDataFrame(data, columns), spark.createDataFrame([(d,) for d in days], "trade_date date")
    got = {(r.code_id, r.trade_date): r for r in bars.densify_calendar(df, cal, ("volume",)).collect()}
    known, want = {(r[1], r[0]): r for r in data}, 0
    for code in range(5):
        close = None
        for d in days[days.index(min(x for c, x in known if c == code)) :]:
            want += 1
            row, before = known.get((code, d)), close
            close = row[5] if row and row[5] is not None else close
            out = got[code, d]
            o, h, lo, p, v, m = (row[2], row[3], row[4], row[6], row[7], row[8]) if row else (None,) * 6
            fill = lambda x: close if x is None else x
            assert (out.close, out.open, out.high, out.low) == (close, fill(o), fill(h), fill(lo))
            assert (out.pre_close, out.volume, out.m, out.is_trade) == (before if p is None else p, v or 0.0, m, int(row is not None))
    assert len(got) == want
    some = cal.where("day(trade_date) in (3, 20)")
    few = bars.densify_calendar(df, cal, ("volume",), days=some)
    assert sorted(map(str, few.collect())) == sorted(str(r) for (_, d), r in got.items() if d.day in (3, 20))
    assert bars.run_length_panel(df, cal).count() == len(data)


def test_densify_and_membership(spark):
    cal = spark.createDataFrame([(D(2020, 1, d),) for d in range(1, 6)], "trade_date date")
    b = spark.createDataFrame([(1, D(2020, 1, 2), 5.0, 5.0, 5.0, 5.0, 5.0, 10.0, 50.0, "Y"), (1, D(2020, 1, 4), 6.0, 6.0, 6.0, 6.0, 5.0, 1.0, 6.0, None)], "code_id long, trade_date date, open double, high double, low double, close double, pre_close double, volume double, amount double, m string")
    out = rows(bars.membership_fill(bars.densify_calendar(b, cal), "m").select("trade_date", "is_trade", "close", "pre_close", "volume", "m"), "trade_date")
    assert out == [(D(2020, 1, 2), 1, 5.0, 5.0, 10.0, "Y"), (D(2020, 1, 3), 0, 5.0, 5.0, 0.0, "Y"), (D(2020, 1, 4), 1, 6.0, 5.0, 1.0, "N"), (D(2020, 1, 5), 0, 6.0, 6.0, 0.0, "Y")]


def test_next_day_state_last_bar(spark):
    df = spark.createDataFrame([(1, D(2020, 1, d), s, f) for d, s, f in ((1, 1, True), (2, 0, True), (3, 1, False))], "code_id long, trade_date date, is_st int, up boolean")
    assert rows(bars.next_day_state(df, ("is_st",), ("up",)).select("trade_date", "next_is_st", "next_up"), "trade_date") == [(D(2020, 1, 1), 0, True), (D(2020, 1, 2), 1, False), (D(2020, 1, 3), 0, None)]


def test_filings_rules(spark):
    f = spark.createDataFrame([(1, D(2020, 3, 31), D(2020, 4, 20), 100.0), (1, D(2020, 9, 30), D(2020, 10, 20), 160.0), (1, D(2020, 12, 31), D(2021, 3, 1), 300.0), (1, D(2020, 12, 31), D(2021, 5, 1), None)], "code_id long, report_date date, publish_date date, r double")
    s = filings.asof_snapshots(f, ["r"]).withColumn("rq", filings.view_quarter("r"))
    s = s.withColumns({"ttm": filings.view_ttm("rq", "r"), "last": filings.back("r", 1)})
    got = {(r.pub, r.report_date): (r.rq, r.ttm, r["last"]) for r in s.collect()}
    assert got[D(2020, 10, 20), D(2020, 9, 30)] == (None, None, None)  # Q2 is missing
    assert got[D(2021, 3, 1), D(2020, 12, 31)] == (140.0, 300.0, 160.0)  # the year itself where quarters are missing
    picked = rows(filings.pick_latest_published(s, ["r"]).select("pub", "report_date", "r"), "pub")
    assert picked[-1] == (D(2021, 5, 1), D(2020, 12, 31), None)  # published but empty doesn't fall back
    assert picked[-2] == (D(2021, 3, 1), D(2020, 12, 31), 300.0)  # nor is the revision seen before its date


def test_negative_base(spark):
    f = spark.createDataFrame([(1, D(2019, 3, 31), D(2019, 4, 1), -10.0), (1, D(2020, 3, 31), D(2020, 4, 1), 5.0)], "code_id long, report_date date, publish_date date, r double")
    s = filings.asof_snapshots(f, ["r"]).select("q", filings.fin_yoy("r").alias("g"), filings.fin_yoy("r", True).alias("p")).where("g is not null or q > 8077").collect()
    assert [(r.g, r.p) for r in s if r.g is not None] == [(1.5, None)]


def test_suffix_rules():
    assert filings.split_flow_stock("R_op_quarter_yoy") == ("R_op", "flow", "quarter_yoy")
    with pytest.raises(ValueError):
        filings.split_flow_stock("B_cash_ttm")
    with pytest.raises(ValueError):
        filings.split_flow_stock("cash")


def test_topm_buffer(spark):
    data = [(D(2020, 1, d), c, r) for d, ranks in enumerate([(1, 2), (2, 1), (3, 1), (1, 3)], 1) for c, r in enumerate(ranks)]
    held = selection.topm_buffer(spark.createDataFrame(data, "trade_date date, code_id long, rank int"), 1, [1.0, 2.0])
    by = {(m, c): sorted(r.trade_date.day for r in held.where(f"mult = {m} and code_id = {c}").collect()) for m in (1.0, 2.0) for c in (0, 1)}
    assert by == {(1.0, 0): [1, 4], (1.0, 1): [2, 3], (2.0, 0): [1, 2, 4], (2.0, 1): [2, 3]}


def test_staged_entry(spark):
    sel = [("s", D(2020, 1, 1), 0, 1), ("s", D(2020, 1, 1), 0, 2), ("s", D(2020, 1, 2), 1, 3), ("s", D(2020, 1, 3), 0, 2)]
    out = selection.staged_entry(spark.createDataFrame(sel, "strategy string, select_date date, stage int, code_id long"), [0.5, 1.0])
    got = {(r.select_date.day, r.code_id): r.share for r in out.collect()}
    assert got == {(1, 1): 0.25, (1, 2): 0.25, (2, 1): 0.25, (2, 2): 0.25, (2, 3): 0.5, (3, 2): 0.25, (3, 3): 0.5}


def fold_by_code(rows, targets):
    """Staged entry, date by date and code by code."""
    held, active, out = {}, {}, {}
    for day in sorted({d for d, _, _ in rows}):
        for stage in {s for d, s, _ in rows if d == day}:
            active[stage] = {c for d, s, c in rows if (d, s) == (day, stage)}
        wanted = set().union(*active.values())
        held = {c: w for c, w in held.items() if c in wanted}
        total, now = targets[min(len(active), len(targets)) - 1], sum(held.values())
        if now > total:
            held = {c: w * total / now for c, w in held.items()}
            now = total
        fresh = [c for c in {c for d, _, c in rows if d == day} if c not in held]
        held |= {c: (total - now) / len(fresh) for c in fresh}
        out |= {(day, c): w for c, w in held.items()}
    return out


def test_staged_entry_by_code(spark):
    import random

    draw, rows = random.Random(5), []
    for s in ("p", "q"):
        for day in range(1, 25):
            for stage in draw.sample(range(3), draw.choice([1, 1, 2])):
                rows += [(s, D(2020, 1, day), stage, c) for c in draw.sample(range(9), draw.randint(1, 4))]
    df = spark.createDataFrame(rows + rows[:5], "strategy string, select_date date, stage int, code_id long")
    for targets in ([0.4, 0.7, 1.0], [0.9, 0.5]):
        got = {(r.strategy, r.select_date, r.code_id): r.share for r in selection.staged_entry(df, targets).collect()}
        want = {(s, *k): w for s in ("p", "q") for k, w in fold_by_code([r[1:] for r in rows if r[0] == s], targets).items()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_staged_entry_spreads_one_strategy(spark):
    """No plan step groups a strategy's codes: pandas sees counts by entry and exit."""
    days = spark.range(40).selectExpr("date_add(date'2020-01-01', cast(id as int)) select_date", "cast(id % 2 as int) stage")
    df = days.crossJoin(spark.range(500).selectExpr("id code_id")).where("(code_id * 7 + dayofyear(select_date) * 3) % 11 < 4").selectExpr("'s' strategy", "*")
    cohorts = staging.holding_intervals(df).groupBy("strategy", "entry", "exit").count()
    assert cohorts.count() <= 40 * 41 / 2
    shares = selection.staged_entry(df, [0.5, 1.0]).groupBy("select_date").agg(F.sum("share").alias("s"))
    assert shares.where("s > 1 + 1e-9").count() == 0
    assert selection.staged_entry(df.limit(0), [1.0]).count() == 0


def test_select_topn_ties_and_share(spark):
    df = panel(spark, [1.0, 1.0, 2.0, None]).withColumnRenamed("x", "score")
    assert [(r.code_id, r.weight) for r in selection.select_topn(df, 1).orderBy("code_id").collect()] == [(0, 0.5), (1, 0.5)]
    assert selection.select_topn(df, 0.75).count() == 3  # the row without score counts in the base


def test_performance(spark):
    def series(rets):
        return spark.createDataFrame([(D(2020, 1, i + 1), r) for i, r in enumerate(rets)], "trade_date date, ret double")

    flat = evaluate.performance_summary(series([0.0, 0.0])).first()
    assert (flat.nav, flat.max_drawdown, flat.longest_win, flat.longest_loss, flat.sharpe) == (1.0, 0.0, 0, 0, None)
    one = evaluate.performance_summary(series([0.1, -0.5, 0.1, 0.1])).first()
    assert one.max_drawdown == pytest.approx(-0.5) and one.longest_win == 2 and one.longest_loss == 1 and one.drawdown_end == D(2020, 1, 2)
    gap = spark.createDataFrame([(D(2020, 1, 5), 0.1), (D(2020, 3, 5), 0.2)], "trade_date date, ret double")
    assert [round(r.ret, 9) for r in evaluate.period_returns(gap).orderBy("period").collect()] == [0.1, 0.0, 0.2]


def test_turnover(spark):
    w = spark.createDataFrame([(D(2020, 1, 1), 1, 0.5), (D(2020, 1, 1), 2, 0.5), (D(2020, 2, 1), 1, 1.0)], "select_date date, code_id long, weight double")
    assert [(r.buy, r.sell) for r in portfolio.turnover_cost(w).orderBy("select_date").collect()] == [(1.0, 0.0), (0.5, 0.5)]


def test_incremental_plan(spark):
    state = spark.createDataFrame([(1, "a", D(2020, 1, 5), True), (2, "a", D(2020, 1, 9), True), (3, "a", D(2020, 1, 9), True), (4, "a", D(2020, 1, 2), False)], "code_id long, factor string, done_max date, valid boolean")
    source = spark.createDataFrame([(c, D(2020, 1, 9) if c != 3 else D(2020, 1, 8)) for c in range(1, 6)], "code_id long, source_max date")
    got = {r.code_id: (r.action, r.cut) for r in incremental.incremental_plan(state, source, ["a"]).collect()}
    assert got == {1: ("incremental", D(2020, 1, 5)), 2: ("skip", None), 3: ("full", None), 4: ("full", None), 5: ("full", None)}


def test_asof_never_looks_ahead(spark):
    left = spark.createDataFrame([(1, D(2020, 1, d)) for d in (1, 5, 9)], "code_id long, t date")
    right = spark.createDataFrame([(1, D(2020, 1, 5), None), (1, D(2020, 1, 7), 2.0)], "code_id long, u date, v double")
    out = rows(joins.asof_join(left, right, "code_id", "t", "u", ["v"], keep_time="known"), "t")
    assert out == [(1, D(2020, 1, 1), None, None), (1, D(2020, 1, 5), None, D(2020, 1, 5)), (1, D(2020, 1, 9), 2.0, D(2020, 1, 7))]
    assert rows(joins.asof_join(left, right, "code_id", "t", "u", ["v"], strict=True, keep_time="known"), "t")[1][3] is None


def test_session_shift(spark):
    df = spark.createDataFrame([(930,), (1130,), (1300,), (1100,)], "t int")
    assert [r[0] for r in df.select(timing.session_time_shift(F.col("t"), 45)).collect()] == [1015, 1345, 1345, 1315]


def test_names_and_plugins(spark):
    assert plugins.column_name("mom", 20) == "mom_20" and plugins.column_name("mom", False) == "mom"
    p = plugins.Plugins()
    p.factor("f", ("missing",))(lambda n: F.lit(n))
    with pytest.raises(ValueError):
        p.add_factors(panel(spark, [1.0]), [("f", 1)])


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("# 说明\ncode,name,close\nsh600001,浦发,1.5\nsh600002,x,nan\n".encode("gbk"))
    out = readers.scan_bars_csv(spark, str(tmp_path), "code string, name string, close double", banner="#")
    assert rows(out, "code") == [("sh600001", "浦发", 1.5), ("sh600002", "x", None)]
    raw = spark.createDataFrame([(1, "20200331", None, "1.5"), (2, "2020-06-30", "2020-07-01", "x"), (3, None, "2020-07-01", "1")], "code_id long, report_date string, publish_date string, r string")
    assert rows(readers.scan_filings(raw, ["r", "absent"]), "code_id") == [(2, D(2020, 6, 30), D(2020, 7, 1), None, None)]


def test_factor_slice_checks_alignment(spark, tmp_path):
    p = spark.createDataFrame([(D(2020, 1, 1), 1, 1.0, 2.0)], "trade_date date, code_id long, close double, f double")
    readers.write_panel(p, str(tmp_path / "p"), ("f",))
    assert rows(readers.load_factor_slice(spark, str(tmp_path / "p"), ["close"], ["f"], check=True), "code_id") == [(D(2020, 1, 1), 1, 1.0, 2.0)]
    p.where("code_id > 1").select("trade_date", "code_id", "f").write.mode("overwrite").parquet(str(tmp_path / "p/factor=f"))
    with pytest.raises(ValueError):
        readers.load_factor_slice(spark, str(tmp_path / "p"), ["close"], ["f"], check=True)


def test_bucketed_slice_moves_no_row(spark, tmp_path):
    data = [(D(2020, 1, d), c, float(d), float(c), float(c * d)) for c in range(50) for d in range(1, 6)]
    p = spark.createDataFrame(data, "trade_date date, code_id long, close double, f double, g double")
    path = str(tmp_path / "b")
    readers.write_bucketed_panel(p, path, ("f", "g"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = readers.load_bucketed_slice(spark, path, ["close"], ["f", "g"])
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.trade_date, r.code_id, r.close, r.f, r.g) for r in out.collect()) == sorted(data)
        few = readers.load_bucketed_slice(spark, path, ["close"], ["f"], codes=[7])
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "EqualTo(code_id,7)" in plan and few.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weights_with_exits(spark):
    rows_ = [("s", D(2020, 1, d), c, 0.5) for d, c in ((1, 1), (1, 2), (2, 1), (4, 1), (5, 2))] + [("s", D(2020, 1, 1), 1, 0.25), ("s", D(2020, 1, 9), 1, 1.0)]
    w = spark.createDataFrame(rows_, "strategy string, select_date date, code_id long, weight double")
    dates = spark.createDataFrame([(D(2020, 1, d),) for d in range(1, 6)], "select_date date")
    got = {(r.select_date.day, r.code_id): r.weight for r in selection.weights_with_exits(w, dates).collect()}
    assert got == {(1, 1): 0.75, (1, 2): 0.5, (2, 1): 0.5, (2, 2): 0.0, (3, 1): 0.0, (4, 1): 0.5, (5, 1): 0.0, (5, 2): 0.5}
    grid = {(r.select_date.day, r.code_id): r.weight for r in selection.weights_matrix(w, dates).collect()}
    assert all(grid[k] == v for k, v in got.items()) and all(v == 0 for k, v in grid.items() if k not in got)


def test_stream_equals_batch(spark, tmp_path):
    from panelfx.streaming import hour_bar_stream, upsert_stream
    from panelfx.streaming.refresh import read_latest

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    bars_ = hour_bar_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    # complete hours come out once the watermark passes: a far later event closes them
    late = spark.createDataFrame([(-1, dt.datetime(2100, 1, 1), 0.0)], events.schema)
    query = upsert_stream(bars_, str(tmp_path / "out"), ["user_id", "bar_ts"], str(tmp_path / "cp"))
    query.awaitTermination()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        upsert_stream(bars_, str(tmp_path / "out"), ["user_id", "bar_ts"], str(tmp_path / "cp")).awaitTermination()
    got = read_latest(spark, str(tmp_path / "out")).where("user_id >= 0")
    want = hour_bar_stream(events)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).isEmpty()


def test_training_queries_use_every_window(spark, monkeypatch):
    """All windows, with the operators' own seeds and parameters; the operator itself is replaced."""
    from panelfx.plans import queries
    from panelfx.plans.datasets import ops

    seen = []

    def train(dataset, features, label, windows, seeds=(1, 2, 3, 4, 5), kind="gbt", params=None, predict_on="test"):
        seen.append((windows.count(), seeds, params))
        return spark.createDataFrame([], "window_id int, trade_date date, code_id long, label double, ml_factor double"), None

    monkeypatch.setattr(ops, "rolling_train_predict", train)
    sf = "/root/testdata/sf0.001"
    n = queries()["rolling_windows"](spark, sf).count()
    for name in ("rolling_train_predict", "rolling_train_linear"):
        queries()[name](spark, sf)
    assert n > 2 and [x[0] for x in seen] == [n] * 2
    for name in ("param_search", "validate_params"):  # these don't train window by window
        assert {r.windows for r in queries()[name](spark, sf).collect()} == {n}
    assert seen[0][1:] == seen[1][1:] == ((1, 2, 3, 4, 5), None)


def test_rolling_train_linear_predicts_every_window(spark):
    from panelfx.plans import queries

    sf = "/root/testdata/sf0.001"
    got = {r.window_id for r in queries()["rolling_train_linear"](spark, sf).select("window_id").distinct().collect()}
    days, windows = queries()["build_dataset"](spark, sf).select("trade_date").distinct(), queries()["rolling_windows"](spark, sf)
    want = {r.window_id for r in days.join(windows, (F.col("trade_date") >= F.col("test_start")) & (F.col("trade_date") < F.col("test_end"))).select("window_id").distinct().collect()}
    assert got == want and len(want) > 2


def test_rates_are_resolved_once_a_day(spark):
    days = [D(2020, 1, 1), D(2020, 1, 3), D(2020, 1, 4), None]
    home = spark.createDataFrame([(c, d) for c in (1, 2, 3) for d in days] + [(1, D(2020, 1, 3))], "code_id long, trade_date date")
    foreign = spark.createDataFrame([(1, D(2020, 1, 2), 5.0), (2, D(2019, 12, 30), 7.0)], "code_id long, trade_date date, foreign_close double")
    fx = spark.createDataFrame([(D(2020, 1, 2), 2.0), (D(2020, 1, 4), 3.0), (D(2020, 1, 4), 4.0), (None, 9.0)], "trade_date date, rate double")
    out = joins.ordered_merge_ffill(home, foreign, fx, "code_id")
    close = {(1, days[1]): 5.0, (1, days[2]): 5.0, (2, days[0]): 7.0, (2, days[1]): 7.0, (2, days[2]): 7.0}
    rate = {days[1]: 2.0, days[2]: 4.0}
    want = [(c, d, close.get((c, d)), rate.get(d), close[c, d] * rate[d] if (c, d) in close and d in rate else None) for c, d in [tuple(r) for r in home.collect()]]
    assert sorted(map(str, (tuple(r) for r in out.select("code_id", "trade_date", "foreign_close", "rate", "foreign_adj").collect()))) == sorted(map(str, want))
    assert "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()  # the bars don't pass a single window


def test_ordered_merge_ffill_has_every_bar(spark):
    from panelfx.plans import queries
    from panelfx.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    got = queries()["ordered_merge_ffill"](spark, sf).collect()
    t = Tables(spark, sf)
    n, orders = t.supplier.count(), t.orders.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "o_orderkey").collect()
    foreign, rates, last = {}, {}, {}
    for r in orders:
        rates.setdefault(r.day, []).append(1 + r.o_orderkey % 7 / 10)
        if not (r.o_custkey % 10 == 3 and r.day > D(1996, 1, 1)):
            of = foreign.setdefault(r.o_custkey % n, {})
            day = r.day + dt.timedelta(92)
            of[day] = max(of.get(day, 0.0), float(r.o_totalprice))
    bars = t.bars_m.select("code_id", "trade_date").collect()
    for r in bars:
        last[r.code_id] = max(last.get(r.code_id, r.trade_date), r.trade_date)
    want = {}
    for r in bars:
        of = foreign.get(r.code_id, {})
        before = [d for d in of if d <= r.trade_date] if of and (last[r.code_id] - max(of)).days <= 10 else []
        known = [d for d in rates if d <= r.trade_date]
        want[r.code_id, r.trade_date] = (of[max(before)] if before else None, sum(rates[max(known)]) / len(rates[max(known)]) if known else None)
    assert len(got) == len(want) and {r.code_id for r in got} == set(last) and sum(r.foreign_adj is not None for r in got) >= len(got) / 2 and any(r.foreign_adj is None for r in got)
    for r in got:
        close, rate = want[r.code_id, r.trade_date]
        assert r.foreign_close == close and (r.rate is None if rate is None else r.rate == pytest.approx(rate, abs=2e-6))
        assert r.foreign_adj is None if close is None or rate is None else r.foreign_adj == pytest.approx(close * r.rate, abs=1e-3)


def test_hourly_weights_is_brute_force(spark):
    from panelfx.plans import queries
    from panelfx.plans.selection import _weights
    from panelfx.sources.fixtures import Tables

    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    days = sorted(r.trade_date for r in t.calendar.collect())
    amount = {(r.code_id, r.trade_date): r.amount for r in t.bars_d.collect()}
    chosen = {}
    for r in _weights(t).collect():
        of = chosen.setdefault(r.select_date, {})
        of[r.code_id] = of.get(r.code_id, 0.0) + r.weight
    begins = {}
    for d in sorted(chosen):  # of selections that take effect on one day, the latest holds
        begins[next((x for x in days if x > d), days[-1])] = d
    want, held = {}, None
    for d in days:
        held = begins.get(d, held)
        for code, w in chosen.get(held, {}).items():
            factor = 1.0 if (code, d) not in amount else 0.5 if amount[code, d] > 1000 else 0.9
            for h in ("09:30:00", "10:30:00", "13:00:00", "14:00:00"):
                want[code, f"{d} {h}"] = w * factor
    got = {(r.code_id, r.bar_ts): r.weight for r in queries()["hourly_weights"](spark, sf).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert min(ts for _, ts in got) < "1998" and min(chosen) < D(1998, 1, 1)


def test_engine_stands_without_the_corpus_operators():
    """Nothing outside panelfx.llm imports it."""
    import re
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "panelfx"
    found = [p.name for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M)]
    assert not found


def test_legacy_growth_keeps_negative_bases(spark):
    import datetime as dt

    from panelfx.operators import filings

    d = dt.date
    rows = [(1, d(2020, 3, 31), d(2020, 4, 20), -10.0, 5.0), (1, d(2020, 6, 30), d(2020, 8, 20), 10.0, 10.0), (1, d(2021, 3, 31), d(2021, 4, 20), 5.0, 0.0), (1, d(2020, 12, 31), d(2021, 4, 25), 40.0, 1.0)]
    out = filings.legacy_growth(spark.createDataFrame(rows, "code_id long, report_date date, publish_date date, r double, b double"), "r", "b").orderBy("report_date").collect()
    assert [r.report_date for r in out] == [d(2020, 3, 31), d(2020, 6, 30), d(2021, 3, 31)]  # the year's report came after a later one
    half, first = out[1], out[2]
    assert half.sq == 20.0 and half.sq_qoq == 1 - 20.0 / -10.0 and half.stock_qoq == 1.0 and half.sq_yoy is None
    assert first.sq_yoy == 1 - 5.0 / -10.0 and first.stock_yoy == -1.0


def test_upsert_has_a_defined_winner(spark):
    from panelfx.operators import incremental

    old = spark.createDataFrame([(1, "a", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "b", 3), (1, "c", 2), (2, "x", 1), (2, "y", 1)], "k int, v string, at int")
    for n in (1, 4):
        got = {r.k: r.v for r in incremental.upsert_keep_last(old, new.repartition(n), ["k"], ["at"]).collect()}
        assert got == {1: "b", 2: "y"}


def test_neutralize_collinear_and_infinite(spark):
    from panelfx.operators import cross_section as xs

    rows = [(1, 1, float(i), 2.0 * i, float(i * i)) for i in range(6)] + [(1, 1, float("inf"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "trade_date int, industry int, a double, b double, y double")
    out = xs.neutralize_multi(df, "y", ["a", "b"], out="res").collect()
    one = {r.a: r.res for r in xs.neutralize_multi(df.where("a < 1e9"), "y", ["a"], out="res").collect()}
    assert all(abs(r.res - one[r.a]) < 1e-9 for r in out if r.a != float("inf")) and [r.res for r in out if r.a == float("inf")] == [None]


def test_keyed_bijection_and_ordinals(spark):
    from panelfx.operators import datasets as ops

    for n in (1, 2, 3, 17, 1000, 4097):
        out = ops.permuted(np.arange(n), n, 5)
        assert sorted(out.tolist()) == list(range(n))
    assert (ops.permuted(np.arange(1000), 1000, 5) == np.arange(1000)).mean() < 0.02
    assert (ops.permuted(np.arange(1000), 1000, 5) == ops.permuted(np.arange(1000), 1000, 6)).mean() < 0.02
    df = spark.range(1000).repartition(7).where("id % 3 > 0")
    numbered, n = ops.with_ordinals(df, "i")
    got = numbered.collect()
    assert n == len(got) == 666 and sorted(r.i for r in got) == list(range(n))
    assert ops.with_ordinals(df.limit(0), "i")[0].count() == 0


def test_permutation_of_all_rows(spark):
    from panelfx.operators import datasets as ops

    draw = np.random.default_rng(2)
    df = spark.createDataFrame([(D(2020, 1, 1), i, float(a), float(b), float(2 * a)) for i, (a, b) in enumerate(draw.normal(size=(500, 2)))], "trade_date date, code_id long, a double, b double, label double").repartition(5)
    model = ops._model("linear", {}, 1).fit(ops._assembled(df, ["a", "b"], "label"))
    out = ops.permutation_importance(model, df, ["a", "b"], "label", n=None)
    got = {r.feature: r.delta for r in out.collect()}
    assert 2.5 < got["a"] < 3.2 and abs(got["b"]) < 1e-6  # of two draws of deviation 2: 2 * sqrt(2)
    assert "SinglePartition" not in ops.with_ordinals(df, "i")[0]._jdf.queryExecution().executedPlan().toString()


def test_importance_search_and_permutation(spark):
    """Importances of fitted trees against the model's own, RMSEs and the metric's direction, a permutation by hand."""
    import datetime as dt

    import numpy as np

    from panelfx.operators import datasets as ops

    rng = np.random.default_rng(3)
    days = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(30)]
    rows = [(d, c, float(a), float(b), float(3 * a + 0.1 * rng.normal())) for d in days for c in range(20) for a, b in [rng.normal(size=2)]]
    df = spark.createDataFrame(rows, "trade_date date, code_id long, a double, b double, label double")
    windows = ops.rolling_windows(df, 24, 6, 3, 3)
    imp = ops.rolling_importance(df, ["a", "b"], "label", windows.limit(1), params={"maxIter": 3, "maxDepth": 2})
    by = {r.feature: r for r in imp.collect()}
    assert by["a"].gain > 10 * by["b"].gain and by["a"].splits > 0
    tries = ops.sample_params({"regParam": (0.0, 2.0, 0.5), "elasticNetParam": [0.0]}, 3, seed=2)
    assert len(tries) == 3 and all(t["regParam"] in (0.0, 0.5, 1.0, 1.5, 2.0) for t in tries)
    found = ops.param_search(df, ["a", "b"], "label", windows.limit(1), [{"regParam": 5.0}, {"regParam": 0.0}], metric="val_rmse").collect()
    best = [r for r in found if r.best]
    assert len(best) == 1 and best[0].trial == 1 and best[0].val_rmse == min(r.val_rmse for r in found)
    assert all(abs(r.overfit_ratio - r.val_rmse / r.train_rmse) < 1e-9 for r in found)
    model = ops._model("linear", {}, 1).fit(ops._assembled(df, ["a", "b"], "label"))
    got = {r.feature: r.delta for r in ops.permutation_importance(model, df, ["a", "b"], "label", n=200).collect()}
    sample = [(r.a, r.b, r.label) for r in ops.sample_rows(df, 200, ["trade_date", "code_id"]).collect()]
    weights, x = model.coefficients.toArray(), np.array(sample)

    def rmse(m):
        return float(np.sqrt(np.mean((m @ weights + model.intercept - x[:, 2]) ** 2)))

    for k, f in enumerate(("a", "b")):
        mixed = x[:, :2].copy()
        mixed[ops.permuted(np.arange(200), 200, 1000 + k), k] = x[:, k]
        assert abs(got[f] - (rmse(mixed) - rmse(x[:, :2]))) < 1e-9
