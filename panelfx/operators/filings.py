"""Point-in-time fundamentals. A filing is (code_id, report_date, publish_date, fields ...); a snapshot is what was known
at a publish date: (code_id, pub, report_date, q, known_on, fields ...), q = year * 4 + quarter of the report.

Quarter arithmetic looks n calendar quarters back within one snapshot: a window ordered by q with the frame
rangeBetween(-n, -n). A missing quarter gives NULL, a revision changes only later snapshots, and all columns of one
query share a single sort. Published but empty (NULL) is a value of its own: it never falls back to an older quarter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import div
from .joins import asof_join

KEY = "code_id"


def qidx(report: str = "report_date") -> Column:
    return F.year(report) * 4 + F.quarter(report)


def deadline(report: str = "report_date") -> Column:
    """Legal deadline of a report: Q1 Apr 30, H1 Aug 31, Q3 Oct 31, FY Apr 30 of the next year."""
    y, q = F.year(report), F.quarter(report)
    return F.when(q == 1, F.make_date(y, F.lit(4), F.lit(30))).when(q == 2, F.make_date(y, F.lit(8), F.lit(31))).when(q == 3, F.make_date(y, F.lit(10), F.lit(31))).otherwise(F.make_date(y + 1, F.lit(4), F.lit(30)))


def filing_calendar(filings: DataFrame) -> DataFrame:
    """report_date, publish_date (deadline): quarter ends from the first to the last report of filings."""
    span = filings.agg(F.min("report_date").alias("a"), F.max("report_date").alias("b")).where("a is not null")
    ends = span.select("b", F.explode(F.sequence(F.trunc("a", "quarter"), F.trunc("b", "quarter"), F.expr("interval 3 month"))).alias("d"))
    return ends.select(F.last_day(F.add_months("d", 2)).alias("report_date")).withColumn("publish_date", deadline())


def statutory_calendar(spark, start: str, end: str) -> DataFrame:
    """report_date, publish_date (deadline): quarter ends from start to end."""
    ends = spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}', interval 3 month)) AS d").select(F.last_day("d").alias("report_date"))
    return ends.where(F.col("report_date") <= F.lit(end).cast("date")).withColumn("publish_date", deadline())


def clean_filings(filings: DataFrame, statutory: DataFrame, fields: list[str], delay_late_feed: bool = False) -> DataFrame:
    """Filings with a statutory row for each quarter from a code's first to its last report (its deadline, unless that is
    after the code's last publication), each field carried forward over the revisions of a report, one row for each
    (publish, report), and nothing before the first real filing. is_real tells which rows were filed. delay_late_feed:
    a filing counts from the deadline on if it came earlier."""
    span = filings.groupBy(KEY).agg(F.min("publish_date").alias("__p0"), F.max("publish_date").alias("__p1"), F.min("report_date").alias("__r0"), F.max("report_date").alias("__r1"))
    due = span.join(F.broadcast(statutory), (F.col("report_date") >= F.col("__r0")) & (F.col("report_date") <= F.col("__r1")) & (F.col("publish_date") >= F.col("__p0")) & (F.col("publish_date") <= F.col("__p1")))
    real = filings.withColumn("publish_date", F.greatest("publish_date", deadline())) if delay_late_feed else filings
    rows = real.select(KEY, "report_date", "publish_date", *fields, F.lit(1).alias("is_real"))
    rows = rows.unionByName(due.select(KEY, "report_date", "publish_date", F.lit(0).alias("is_real")), allowMissingColumns=True)
    w = Window.partitionBy(KEY, "report_date").orderBy("publish_date", "is_real").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f: F.last(f, ignorenulls=True).over(w) for f in fields})
    keep = F.row_number().over(Window.partitionBy(KEY, "report_date", "publish_date").orderBy(F.desc("is_real"), *(F.desc_nulls_last(f) for f in fields)))
    return rows.withColumn("__k", keep).where("__k = 1").drop("__k")


def late_filing_anchor(filings: DataFrame, fields: list[str]) -> DataFrame:
    """Adds a blank row at the deadline of each report whose first filing came after it."""
    late = filings.groupBy(KEY, "report_date").agg(F.min("publish_date").alias("__first")).withColumn("publish_date", deadline()).where(F.col("__first") > F.col("publish_date"))
    return filings.select(KEY, "report_date", "publish_date", *fields).unionByName(late.select(KEY, "report_date", "publish_date"), allowMissingColumns=True)


def asof_snapshots(filings: DataFrame, fields: list[str], look_back: int | None = None) -> DataFrame:
    """For each (code, publish date), the latest known row of every quarter published so far. look_back keeps the newest
    quarters of each snapshot: what an operator needs, as quarters x dates grows with the square of a code's history."""
    f = filings.select(KEY, "report_date", F.col("publish_date").alias("known_on"), *fields)
    if look_back:  # a publish date meets the filings of the quarters that it looks at, and no others
        newest = F.max(qidx()).over(Window.partitionBy(KEY).orderBy("publish_date").rangeBetween(Window.unboundedPreceding, 0))
        pubs = filings.select(KEY, F.col("publish_date").alias("pub"), newest.alias("__n")).distinct()
        pubs = pubs.select(KEY, "pub", F.explode(F.sequence(F.col("__n") - look_back + 1, F.col("__n"))).alias("__q"))
        seen = pubs.join(f.withColumn("__q", qidx()), [KEY, "__q"]).drop("__q")
    else:
        seen = filings.select(KEY, F.col("publish_date").alias("pub")).distinct().join(f, KEY)
    seen = seen.where(F.col("known_on") <= F.col("pub"))
    best = seen.groupBy(KEY, "pub", "report_date").agg(F.max_by(F.struct("known_on", *fields), F.struct("known_on", *fields)).alias("v"))
    return best.select(KEY, "pub", "report_date", qidx().alias("q"), "v.known_on", *(f"v.{x}" for x in fields))


def mark_superseded(filings: DataFrame) -> DataFrame:
    """Adds superseded: an earlier-published row has a later report."""
    before = F.max("report_date").over(Window.partitionBy(KEY).orderBy("publish_date", "report_date").rowsBetween(Window.unboundedPreceding, -1))
    return filings.withColumn("superseded", F.coalesce(before > F.col("report_date"), F.lit(False)))


def _filed_before(rows: DataFrame, fields: list[str], back: dict[str, Column], names) -> DataFrame:
    """rows (with q) and, for each look-up and field, what was filed before the row (by publish date, then report) for the
    quarter that many quarters earlier; names(look-up, field) is the new column."""
    value = F.struct(*(F.col(f).alias(f"v{i}") for i, f in enumerate(fields)))
    other = rows.select(KEY, F.col("q").alias("__q"), F.col("publish_date").alias("__p"), F.col("report_date").alias("__r"), value.alias("__v"))
    wanted = rows.select(KEY, "report_date", "publish_date", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), (F.col("q") - b).alias("t")) for n, b in back.items()))).alias("w"))
    hit = wanted.join(other, (wanted[KEY] == other[KEY]) & (F.col("w.t") == F.col("__q")) & (F.struct("__p", "__r") < F.struct("publish_date", "report_date"))).select(wanted[KEY], "report_date", "publish_date", "w.name", "__p", "__r", "__v")
    last = hit.groupBy(KEY, "report_date", "publish_date").pivot("name", list(back)).agg(F.max_by("__v", F.struct("__p", "__r")))
    got = last.select(KEY, "report_date", "publish_date", *(F.col(f"{n}.v{i}").alias(names(n, f)) for n in back for i, f in enumerate(fields)))
    return rows.join(got, [KEY, "report_date", "publish_date"], "left")


def filing_history_lookup(filings: DataFrame, field: str) -> DataFrame:
    """Adds to each filing what was filed before it (by publish date, then report) for: the quarter before (prev_q), the
    same quarter last year (same_q), the last fiscal year (last_fy) and last year's first three quarters."""
    q = F.quarter("report_date")
    back = {"prev_q": F.lit(1), "same_q": F.lit(4), "last_fy": q, "last_q1": q + 3, "last_q2": q + 2, "last_q3": q + 1}
    return _filed_before(filings.withColumn("q", qidx()), [field], back, lambda n, f: n)


def _growth(cur, base) -> Column:
    """cur / base - 1, or 1 - cur / base for a negative base."""
    return F.when(base < 0, 1 - div(cur, base)).otherwise(div(cur, base) - 1)


def legacy_derive(filings: DataFrame, field: str) -> DataFrame:
    """On filing rows of a year-to-date field: single quarter (sq), year-to-date growth (ytd_yoy), and trailing twelve
    months (ttm: year to date + last fiscal year - same year to date a year before; the fiscal year itself in the fourth
    quarter)."""
    h = filing_history_lookup(filings, field)
    v, q = F.col(field), F.quarter("report_date")
    return h.withColumns({"sq": F.when(q == 1, v).otherwise(v - F.col("prev_q")), "ytd_yoy": _growth(v, F.col("same_q")), "ttm": F.when(q == 4, v).otherwise(v + F.col("last_fy") - F.col("same_q"))})


def legacy_growth(filings: DataFrame, flow: str, stock: str, drop_superseded: bool = True) -> DataFrame:
    """legacy_derive's columns of the flow field, and growth on what was filed before for the quarter before and for the
    same quarter last year: of the single quarter (sq_qoq, sq_yoy), of the trailing twelve months (ttm_yoy) and of a stock
    field (stock_qoq, stock_yoy). drop_superseded: reports that came after a later one only serve as a base."""
    rows = _filed_before(legacy_derive(filings, flow), ["sq", "ttm", stock], {"b1": F.lit(1), "b4": F.lit(4)}, lambda n, f: f"__{n}_{f}")
    grown = {"sq_qoq": ("sq", "b1"), "sq_yoy": ("sq", "b4"), "ttm_yoy": ("ttm", "b4"), "stock_qoq": (stock, "b1"), "stock_yoy": (stock, "b4")}
    out = rows.withColumns({n: _growth(F.col(f), F.col(f"__{b}_{f}")) for n, (f, b) in grown.items()}).drop(*(f"__{b}_{f}" for b in ("b1", "b4") for f in ("sq", "ttm", stock)))
    return mark_superseded(out).where("not superseded").drop("superseded") if drop_superseded else out


def split_names(name: Column) -> Column:
    """As split_flow_stock, for a column of names: a struct of field, kind and suffix; kind is NULL for names of no kind and
    for stock fields with a view that they don't have."""
    low = F.lower(name)
    suffix = F.regexp_extract(low, "_(quarter_yoy|quarter_qoq|ttm_yoy|quarter|ttm|annual|raw|yoy|qoq)$", 1)
    field = F.when(suffix == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1))
    stock_only = ~suffix.isin("quarter", "ttm", "ttm_yoy", "quarter_yoy", "quarter_qoq")
    head = F.upper(F.substring(field, 1, 2))
    kind = F.when(head.isin("R_", "C_"), "flow").when((head == "B_") & stock_only, "stock")
    return F.struct(field.alias("field"), kind.alias("kind"), F.when(suffix == "", "raw").otherwise(suffix).alias("suffix"))


def split_flow_stock(name: str) -> tuple[str, str, str]:
    """(field, kind, suffix) of a column name such as R_revenue_yoy or r_revenue_ttm. Flow fields begin with R_ or
    C_, stock fields with B_; stock fields have no quarter or trailing view."""
    flow_only, suffixes = ("quarter", "ttm", "ttm_yoy", "quarter_yoy", "quarter_qoq"), ("quarter_yoy", "quarter_qoq", "ttm_yoy", "quarter", "ttm", "annual", "raw", "yoy", "qoq")
    suffix = next((s for s in suffixes if name.lower().endswith("_" + s)), "raw")
    field = name[: -len(suffix) - 1] if name.lower().endswith("_" + suffix) else name
    kind = {"R_": "flow", "C_": "flow", "B_": "stock"}.get(field[:2].upper())
    if kind is None:
        raise ValueError(f"{name}: fields begin with R_, C_ or B_")
    if kind == "stock" and suffix in flow_only:
        raise ValueError(f"{name}: a stock field has no {suffix}")
    return field, kind, suffix


# ---- expressions over snapshots ----------------------------------------------------------------------------------


def back(x: str | Column, n: int) -> Column:
    """The value n calendar quarters earlier in the same snapshot."""
    if not n:
        return F.col(x) if isinstance(x, str) else x
    return F.max(x).over(Window.partitionBy(KEY, "pub").orderBy("q").rangeBetween(-n, -n))


def frame(n: int):
    """The last n calendar quarters of the snapshot."""
    return Window.partitionBy(KEY, "pub").orderBy("q").rangeBetween(-(n - 1), 0)


_Q = F.quarter


def view_quarter(x: str) -> Column:
    return F.when(_Q("report_date") == 1, F.col(x)).otherwise(F.col(x) - back(x, 1))


def view_ttm(quarter: str, raw: str) -> Column:
    """Sum of four single quarters, all known; in the fourth quarter the year itself where one is missing."""
    full = F.when(F.count(quarter).over(frame(4)) == 4, F.sum(quarter).over(frame(4)))
    return F.coalesce(full, F.when(_Q("report_date") == 4, F.col(raw)))


def view_annual(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(_Q("report_date") == 4)


def _change(cur: Column, prev: Column, exclude_negative: bool) -> Column:
    g = div(cur, prev) - 1
    return F.when(prev > 0, g) if exclude_negative else F.when(prev < 0, -g).otherwise(g)


def fin_qoq(x: str, exclude_negative: bool = False) -> Column:
    return _change(F.col(x), back(x, 1), exclude_negative)


def fin_yoy(x: str, exclude_negative: bool = False) -> Column:
    return _change(F.col(x), back(x, 4), exclude_negative)


def fin_qoq_accel(x: str, lag: int = 1) -> Column:
    """lag 1: (Q0 / Q2 - 1) - (Q1 / Q5 - 1); lag 4: (Q0 / Q4 - 1) - (Q4 / Q8 - 1)."""
    a, b, c = {1: (2, 1, 5), 4: (4, 4, 8)}[lag]
    return (div(F.col(x), back(x, a)) - 1) - (div(back(x, b), back(x, c)) - 1)


def fin_yoy_accel(yoy: str, lag: int = 1) -> Column:
    """A growth column less itself `lag` quarters earlier."""
    return F.col(yoy) - back(yoy, lag)


def fin_diff(x: str, n: int) -> Column:
    """Difference to the quarter before (1) or the same quarter last year (4)."""
    return F.col(x) - back(x, n)


def fin_lag(x: str, n: int, unit: str = "q") -> Column:
    """n quarters (q), years (y) or fiscal year ends (fy) ago; NULL where the current value is NULL."""
    if unit == "fy":
        value = F.coalesce(*(F.when(_Q("report_date") == k, back(x, k + 4 * (n - 1))) for k in (1, 2, 3, 4)))
    else:
        value = back(x, n if unit == "q" else 4 * n)
    return F.when(F.col(x).isNotNull(), value)


def fin_last_n_array(x: str, n: int) -> Column:
    """The last n quarters, oldest first, missing ones NULL."""
    return F.array(*(back(x, k) for k in range(n - 1, -1, -1)))


def fin_cagr(x: str, years: int, exclude_negative: bool = False) -> Column:
    prev = back(x, 4 * years)
    root = F.pow(div(F.col(x), prev), F.lit(1.0 / years))
    root = F.when(~F.isnan(root), root)
    if exclude_negative:
        g = F.when(prev > 0, root - 1)
        return F.when(g >= 0, g)
    return F.when(prev <= 0, 1 - root).otherwise(root - 1)


def fin_stability(x: str, years: int) -> Column:
    """mean / sample deviation of the value and those of the same quarter in the years before; what is missing is left
    out; NULL for a deviation of 0."""
    a = F.filter(F.array(*(back(x, 4 * k) for k in range(years + 1))), lambda v: v.isNotNull())
    n = F.size(a)
    mean = F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), n)
    sd = F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)), n - 1))
    return F.when(sd > 1e-9, mean / sd)


def qdf_rolling(x: str, n: int, fn: str) -> Column:
    """mean, std, var, sum, min, max or median over n calendar quarters, all known."""
    if fn == "median":
        a = F.sort_array(F.array(*(back(x, k) for k in range(n))))
        value = (F.element_at(a, n // 2 + 1) + F.element_at(a, (n + 1) // 2)) / 2
    else:
        value = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum, "min": F.min, "max": F.max}[fn](x).over(frame(n))
    return F.when(F.count(x).over(frame(n)) == n, value)


def qdf_arith(left: DataFrame, right: DataFrame, expr: Column) -> DataFrame:
    """An expression over two quarter series (code, pub, q, value columns of different names), where both have the
    quarter and the publish date."""
    return left.join(right, [KEY, "pub", "q"]).withColumn("value", expr)


def pick_latest_published(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """code, pub, report_date, columns: each snapshot's newest quarter, values as they are (NULL stays NULL)."""
    return snapshots.groupBy(KEY, "pub").agg(F.max_by(F.struct("report_date", *columns), "q").alias("v")).select(KEY, "pub", "v.*")


def align_to_trade_date(days: DataFrame, picked: DataFrame, columns: list[str], day: str = "trade_date") -> DataFrame:
    return asof_join(days, picked, KEY, day, "pub", columns)


def fin_publish_dates(days: DataFrame, filings: DataFrame, quarter: int | None = None) -> DataFrame:
    """Adds, for the newest report visible on each day (of one quarter of the year, if given), its report date, first and
    latest publication so far."""
    if quarter:
        filings = filings.where(F.quarter("report_date") == quarter)
    w = Window.partitionBy(KEY, "report_date").orderBy("publish_date").rowsBetween(Window.unboundedPreceding, 0)
    events = filings.withColumn("first_publish", F.min("publish_date").over(w)).withColumn("newest", F.max("report_date").over(Window.partitionBy(KEY).orderBy("publish_date").rangeBetween(Window.unboundedPreceding, 0)))
    front = events.where("report_date = newest").select(KEY, F.col("publish_date").alias("pub"), "report_date", "first_publish", F.col("publish_date").alias("latest_publish")).distinct()
    return asof_join(days, front, KEY, "trade_date", "pub", ["report_date", "first_publish", "latest_publish"])
