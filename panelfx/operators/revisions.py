"""Fundamentals as known on a day, from changes instead of snapshots.

What is known of a quarter and the quarters before it changes only when one of them is filed or revised. A sweep over
those changes keeps, for each (code, quarter), the latest revision of each quarter looked back at: rows in proportion to
revisions x quarters looked back, where a snapshot of all quarters at each publish date grows with the square of a code's
history. Views are plain expressions over the looked-back columns; the newest quarter's rows are what days are joined to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from .filings import KEY, align_to_trade_date, qidx, split_flow_stock


def _swept(filings: DataFrame, fields: list[str], look_back: int, keep: str) -> DataFrame:
    """The rows that `keep` names of a sweep with a row for each filing k quarters back of each quarter."""
    value = F.struct(F.col("report_date"), *fields)
    known = filings.groupBy(KEY, qidx().alias("q0"), F.col("publish_date").alias("pub")).agg(F.max(value).alias("v"))
    lags = F.explode(F.sequence(F.lit(0), F.lit(look_back))).alias("k")
    events = known.select(KEY, "pub", "v", "q0", lags).withColumn("q", F.col("q0") + F.col("k"))
    upto = Window.partitionBy(KEY, "q").orderBy("pub").rangeBetween(Window.unboundedPreceding, 0)
    state = {f"__{k}": F.last(F.when(F.col("k") == k, F.col("v")), ignorenulls=True).over(upto) for k in range(look_back + 1)}
    once = F.row_number().over(Window.partitionBy(KEY, "q").orderBy("pub", "k"))
    first = F.lag("pub").over(Window.partitionBy(KEY, "q").orderBy("pub", "k"))
    swept = events.withColumns(state | {"__n": once, "__p": first}).where(keep)
    columns = [F.col(f"__{k}.{f}").alias(f"{f}__{k}") for f in fields for k in range(look_back + 1)]
    return swept.select(KEY, "q", F.col("__0.report_date").alias("report_date"), "pub", *columns)


def quarter_changes(filings: DataFrame, fields: list[str], look_back: int) -> DataFrame:
    """code_id, q, report_date, pub and, for each field and k = 0..look_back, `field__k`: what was known of quarter q - k at
    pub; a row for each publish date that changed any of them, from the quarter's own first publication on. Of several
    filings of a quarter on one date the one with the largest values counts."""
    return _swept(filings, fields, look_back, "__0 is not null and (__p is null or __p <> pub)")


def filed_history(filings: DataFrame, fields: list[str], look_back: int) -> DataFrame:
    """The changes at which the quarter itself was filed: what filings.filing_history_lookup finds for each filing, by
    quarters back, without a join of filings."""
    return _swept(filings, fields, look_back, "k = 0")


def newest_quarter(changes: DataFrame) -> DataFrame:
    """The changes of the newest quarter known at their date: what a day's as-of join needs."""
    w = Window.partitionBy(KEY).orderBy("pub").rangeBetween(Window.unboundedPreceding, 0)
    return changes.withColumn("__top", F.max("q").over(w)).where("q = __top").drop("__top")


def newest_report(filings: DataFrame) -> DataFrame:
    """code_id, pub, report_date: the latest report known at each publish date, from one running maximum."""
    upto = Window.partitionBy(KEY).orderBy("publish_date").rangeBetween(Window.unboundedPreceding, 0)
    return filings.select(KEY, F.col("publish_date").alias("pub"), F.max("report_date").over(upto).alias("report_date")).distinct()


def last_year(field: str, quarter: int) -> Column:
    """The field of a quarter (4: the fiscal year) of the year before the quarter's; needs 8 - quarter quarters looked back."""
    place = F.pmod(F.col("q") - 1, F.lit(4)) + 1
    return F.coalesce(*(F.when(place == k, known(field, k + 4 - quarter)) for k in (1, 2, 3, 4)))


def known(field: str, k: int = 0) -> Column:
    """The field k quarters back."""
    return F.col(f"{field}__{k}")


def single(field: str, k: int = 0) -> Column:
    """The single quarter of a year-to-date field, k quarters back."""
    return F.when(F.pmod(F.col("q") - k, F.lit(4)) == 1, known(field, k)).otherwise(known(field, k) - known(field, k + 1))


def trailing_year(field: str, k: int = 0) -> Column:
    """Sum of four single quarters, all known; in a fourth quarter the year itself where one is missing."""
    total = single(field, k) + single(field, k + 1) + single(field, k + 2) + single(field, k + 3)
    return F.coalesce(total, F.when(F.pmod(F.col("q") - k, F.lit(4)) == 0, known(field, k)))


def change(now: Column, before: Column) -> Column:
    g = div(now, before) - 1
    return F.when(before < 0, -g).otherwise(g)


#: view: (quarters looked back, expression of a field)
VIEWS = {
    "raw": (0, known),
    "annual": (0, lambda f: F.when(F.pmod(F.col("q"), F.lit(4)) == 0, known(f))),
    "quarter": (1, single),
    "ttm": (4, trailing_year),
    "yoy": (4, lambda f: change(known(f), known(f, 4))),
    "qoq": (1, lambda f: change(known(f), known(f, 1))),
    "quarter_yoy": (5, lambda f: change(single(f), single(f, 4))),
    "quarter_qoq": (2, lambda f: change(single(f), single(f, 1))),
    "ttm_yoy": (8, lambda f: change(trailing_year(f), trailing_year(f, 4))),
}


#: period: expression of a field, seven quarters looked back
PERIODS = {"prev_q": lambda f: known(f, 1), "same_q": lambda f: known(f, 4), "last_fy": lambda f: last_year(f, 4), **{f"last_q{n}": lambda f, n=n: last_year(f, n) for n in (1, 2, 3)}}


def same_period_join(days: DataFrame, filings: DataFrame, field: str, day: str = "trade_date") -> DataFrame:
    """Adds to daily rows the field of the newest quarter known on the day, and of each of PERIODS what had been filed before
    the code's latest filing at or before the day: a late one of an older report too; of one date the latest report. A
    period that this filing has nothing of keeps what the code's day before has."""
    upto = Window.partitionBy(KEY).orderBy("pub").rangeBetween(Window.unboundedPreceding, 0)
    newest = F.max(F.struct("q", "pub", known(field).alias("v"))).over(upto)["v"]
    filed = filed_history(filings, [field], 7).select(KEY, "pub", "q", newest.alias(field), *(c(field).alias(n) for n, c in PERIODS.items()))
    out = align_to_trade_date(days, filed, ["q", field, *PERIODS], day).drop("q")
    so_far = Window.partitionBy(KEY).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({n: F.last(n, ignorenulls=True).over(so_far) for n in PERIODS})


def fin_columns(filings: DataFrame, days: DataFrame, wanted: list[str]) -> DataFrame:
    """Adds fundamentals by name (field_view, as r_revenue_ttm) to daily rows, all from one sweep over the changes."""
    parsed = {w: split_flow_stock(w) for w in wanted}
    fields = sorted({f for f, _, _ in parsed.values()})
    depth = max(VIEWS[v][0] for _, _, v in parsed.values())
    front = newest_quarter(quarter_changes(filings, fields, depth))
    picked = front.select(KEY, "pub", *(VIEWS[v][1](f).alias(w) for w, (f, _, v) in parsed.items()))
    return align_to_trade_date(days, picked, wanted)
