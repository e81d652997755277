"""Large inputs: shuffles follow the size of the files, and fundamentals come without snapshots of all quarters."""

import pytest

from panelfx.functions import lineage
from panelfx.plans import queries
from panelfx.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def test_a_large_input_gets_more_partitions_in_a_session_of_its_own(spark, monkeypatch):
    """A task's share of rows grew with the table."""
    assert Tables(spark, SF).spark is spark
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lineage, "SHARE", lineage.file_bytes(spark, f"{SF}/lineitem.parquet") // 8)
    own = Tables(spark, SF).spark
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= 8 and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert lineage.file_bytes(spark, f"{SF}/no_such_table.parquet") == 0


@pytest.mark.parametrize("name", ["agg_group", "membership_fill", "fin_same_period_join", "incremental_recompute"])
def test_results_do_not_depend_on_the_session(spark, monkeypatch, name):
    want = sorted(map(str, queries()[name](spark, SF).collect()))
    monkeypatch.setattr(lineage, "SHARE", 30_000)
    assert sorted(map(str, queries()[name](spark, SF).collect())) == want


@pytest.mark.parametrize("name", ["aligned_arith", "fin_report_meta", "fin_same_period_join", "align_to_trade_date"])
def test_no_snapshot_of_all_quarters_at_each_publish_date(spark, name):
    """Each publish date was joined with all filings of its code, rows with the square of a code's history."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_membership_is_carried_over_bars_not_days(spark):
    """a window sorted and held every calendar day of the codes."""
    plan = queries()["membership_fill"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    days = next(i for i, line in enumerate(plan) if "Generate" in line)
    codes = [i for i, line in enumerate(plan) if line.lstrip(" +-:").startswith("Window") and "code_id" in line]
    assert codes and min(codes) > days


def test_membership_days_equal_the_fill_of_dense_days(spark):
    from panelfx.operators import bars

    t = Tables(spark, SF)
    marked = t.bars_d.selectExpr("*", "case when volume > 30 then 'Y' when volume > 20 then 'N' when code_id % 2 = 0 and volume > 10 then 'X' end as m")
    dense = bars.membership_fill(bars.densify_calendar(marked, t.calendar), "m").select("code_id", "trade_date", "is_trade", "m")
    assert sorted(map(str, bars.membership_days(marked, t.calendar, "m").collect())) == sorted(map(str, dense.collect()))


@pytest.mark.parametrize("name", ["build_dataset", "preprocess_many"])
def test_no_window_holds_a_dates_rows(spark, name):
    """Windows by (factor, date) sorted all codes of a date in one task."""
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_a_session_of_its_own_has_small_shares(spark, monkeypatch):
    """with a partition for each 8 MB of files and 32 MB a task, a task's memory still grew up to 6 GB."""
    own = lineage.sized_session(spark, 1 << 30)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= 512 and own.conf.get(lineage.ADVISED) == "8m"
