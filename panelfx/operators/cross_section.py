"""Cross-sectional transforms: everything within one trade date (or within one date of each factor of a long table)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import avg_rank, cap, min_rank
from ..functions.lineage import parquet_copy

DAY = "trade_date"
ZERO = 1e-12


def _flag(c: str) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0))


REASONS = {
    "risk_mark": lambda: F.upper("name").contains("ST"),
    "new_listing": lambda: F.coalesce("listed_days", F.lit(0)) < 250,
    "not_trading": lambda: _flag("next_is_trade") == 0,
    "open_limit": lambda: _flag("next_open_up_limit") == 1,
    "next_st": lambda: _flag("next_is_st") == 1,
    "next_delist": lambda: _flag("next_is_delist") == 1,
    "one_price": lambda: _flag("next_one_price_up") == 1,
}


def tradable_filter(panel: DataFrame) -> DataFrame:
    """Drops rows that can't be bought the next day; missing flags count as 0."""
    return panel.where(~reduce(Column.__or__, (F.coalesce(r(), F.lit(False)) for r in REASONS.values())))


def filter_summary(panel: DataFrame) -> DataFrame:
    """reason, n: rows of each reason (a row may have several), and those kept, dropped and all."""
    bad = reduce(Column.__or__, (F.coalesce(r(), F.lit(False)) for r in REASONS.values()))
    counts = {k: r() for k, r in REASONS.items()} | {"kept": ~bad, "dropped": bad, "all": F.lit(True)}
    one = panel.agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    return one.unpivot([], list(counts), "reason", "n")


def mad_clip(x: str, keys: list[str], n: float = 3.0) -> list[tuple[str, Column]]:
    """Steps (column, expression) that clip x to its median plus and minus n * 1.4826 * median absolute deviation within
    keys; unchanged where the deviation is NULL or 0."""
    w = Window.partitionBy(*keys)
    width = n * 1.4826 * F.col(f"__{x}_mad")
    clipped = F.when(F.coalesce(F.col(f"__{x}_mad"), F.lit(0.0)) == 0, F.col(x)).otherwise(F.when(F.col(x).isNotNull(), cap(x, F.col(f"__{x}_med") - width, F.col(f"__{x}_med") + width)))
    return [(f"__{x}_med", F.median(x).over(w)), (f"__{x}_mad", F.median(F.abs(F.col(x) - F.col(f"__{x}_med"))).over(w)), (x, clipped)]


def apply_steps(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df.drop(*[n for n, _ in steps if n.startswith("__")])


def clip_column(df: DataFrame, x: str, keys: list[str] | None = None, n: float = 3.0) -> DataFrame:
    return apply_steps(df, mad_clip(x, keys or [DAY], n))


def neutralize(df: DataFrame, x: str, mv: str = "mv", industry: str = "industry", keys: list[str] | None = None) -> DataFrame:
    """Replaces x by its least-squares residual on ln(mv), industry dummies and an intercept, within keys. By the
    Frisch-Waugh-Lovell theorem that is the regression of x on ln(mv), both less their industry means. Rows without x,
    industry or a positive mv get NULL, as do groups of fewer than two valid rows."""
    keys = keys or [DAY]
    ok = F.col(x).isNotNull() & (F.col(mv) > 0) & F.col(industry).isNotNull()
    group, within = Window.partitionBy(*keys), Window.partitionBy(*keys, industry)
    df = df.withColumn("__ok", F.coalesce(ok, F.lit(False))).withColumn("__y", F.when(F.col("__ok"), F.col(x))).withColumn("__l", F.when(F.col("__ok"), F.log(F.when(F.col(mv) > 0, F.col(mv)))))
    df = df.withColumns({"__y": F.col("__y") - F.avg("__y").over(within), "__l": F.col("__l") - F.avg("__l").over(within)})
    df = df.withColumns({"__ll": F.sum(F.col("__l") * F.col("__l")).over(group), "__ly": F.sum(F.col("__l") * F.col("__y")).over(group), "__n": F.count_if("__ok").over(group)})
    beta = F.when(F.col("__ll") > ZERO, F.col("__ly") / F.col("__ll")).otherwise(0.0)
    return df.withColumn(x, F.when(F.col("__n") >= 2, F.col("__y") - beta * F.col("__l"))).drop("__ok", "__y", "__l", "__ll", "__ly", "__n")


def neutralize_multi(df: DataFrame, x: str, covariates: list[str], industry: str | None = "industry", keys: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Adds the residual of x on the covariates, an intercept and industry dummies, within keys; rows with any NULL or
    infinite value get NULL. Normal equations of the demeaned columns; of (nearly) collinear covariates the first one
    counts. One or two covariates are solved in closed form, more by elimination (neutralize_gram)."""
    keys, out = keys or [DAY], out or f"{x}_res"
    if len(covariates) > 2:
        return neutralize_gram(df, x, covariates, industry, keys, out)
    cols = [x, *covariates]
    finite = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = reduce(Column.__and__, [*(F.col(c).isNotNull() & finite(c) for c in cols), *([F.col(industry).isNotNull()] if industry else [])])
    within = Window.partitionBy(*keys, *([industry] if industry else []))
    group = Window.partitionBy(*keys)
    names = [f"__c{i}" for i in range(len(cols))]
    df = df.withColumns({n: F.when(ok, F.col(c).cast("double")) for n, c in zip(names, cols, strict=True)})
    df = df.withColumns({n: F.col(n) - F.avg(n).over(within) for n in names})
    dot = lambda a, b: F.sum(F.col(a) * F.col(b)).over(group)
    if len(covariates) == 1:
        df = df.withColumns({"__s11": dot("__c1", "__c1"), "__s1y": dot("__c1", "__c0")})
        fit = F.when(F.col("__s11") > ZERO, F.col("__s1y") / F.col("__s11")).otherwise(0.0) * F.col("__c1")
    else:
        df = df.withColumns({"__s11": dot("__c1", "__c1"), "__s22": dot("__c2", "__c2"), "__s12": dot("__c1", "__c2"), "__s1y": dot("__c1", "__c0"), "__s2y": dot("__c2", "__c0")})
        det = F.col("__s11") * F.col("__s22") - F.col("__s12") * F.col("__s12")
        apart = det > 1e-10 * F.col("__s11") * F.col("__s22")  # beyond rounding
        one = F.when(F.col("__s11") > ZERO, F.col("__s1y") / F.col("__s11"))
        two = F.when(F.col("__s11") <= ZERO, F.when(F.col("__s22") > ZERO, F.col("__s2y") / F.col("__s22")))
        b1 = F.when(apart, F.try_divide(F.col("__s1y") * F.col("__s22") - F.col("__s2y") * F.col("__s12"), det)).otherwise(F.coalesce(one, F.lit(0.0)))
        b2 = F.when(apart, F.try_divide(F.col("__s2y") * F.col("__s11") - F.col("__s1y") * F.col("__s12"), det)).otherwise(F.coalesce(two, F.lit(0.0)))
        fit = b1 * F.col("__c1") + b2 * F.col("__c2")
    return df.withColumn(out, F.col("__c0") - fit).drop(*names, "__s11", "__s22", "__s12", "__s1y", "__s2y")


def solve_in_order(gram: Column, p: int) -> Column:
    """The p coefficients (array) of normal equations by Gauss-Jordan elimination in array expressions. gram: the rows of
    the p x (p + 1) system, one after another, the right-hand side last in each. A column whose pivot is within rounding of
    what those before it explain (1e-10 of its own) gets 0: of collinear columns the first one counts."""
    m = p + 1
    own = [gram[k * m + k] for k in range(p)]

    def step(state: Column, k: Column) -> Column:
        g = state["g"]
        pivot = F.element_at(g, (k * m + k + 1).cast("int"))
        use = pivot > 1e-10 * F.element_at(state["own"], (k + 1).cast("int"))

        def cell(v: Column, t: Column) -> Column:
            row, col = F.floor(t / m), t % m
            top = F.element_at(g, (k * m + col + 1).cast("int")) / pivot
            return F.when(~use, v).when(row == k, top).otherwise(v - F.element_at(g, (row * m + k + 1).cast("int")) * top)

        used = F.concat(state["used"], F.array(use))
        return F.struct(F.transform(g, cell).alias("g"), state["own"].alias("own"), used.alias("used"))

    start = F.struct(gram.alias("g"), F.array(*own).alias("own"), F.array().cast("array<boolean>").alias("used"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), start, step)
    return F.transform(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: F.when(F.element_at(done["used"], (k + 1).cast("int")), F.element_at(done["g"], (k * m + p + 1).cast("int"))).otherwise(0.0))


def neutralize_gram(df: DataFrame, x: str, covariates: list[str], industry: str | None, keys: list[str], out: str) -> DataFrame:
    """neutralize_multi for any number of covariates, within the JVM: one exchange by keys; the columns less their industry
    means; one row of sums of products a group; its solution goes back to the group's rows by a join on the same keys."""
    cols = [x, *covariates]
    finite = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    ok = reduce(Column.__and__, [*(F.col(c).isNotNull() & finite(c) for c in cols), *([F.col(industry).isNotNull()] if industry else [])])
    names = [f"__c{i}" for i in range(len(cols))]
    within = Window.partitionBy(*keys, *([industry] if industry else []))
    base = df.repartition(*keys).withColumns({n: F.when(ok, F.col(c).cast("double")) for n, c in zip(names, cols, strict=True)})
    base = base.withColumns({n: F.col(n) - F.avg(n).over(within) for n in names})
    p = len(covariates)
    order = [*range(1, p + 1), 0]
    products = [F.sum(F.col(f"__c{i}") * F.col(f"__c{j}")) for i in range(1, p + 1) for j in order]
    own = [f"__k{i}" for i in range(len(keys))]
    sums = base.where("__c0 is not null").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, own, strict=True)]).agg(F.array(*products).alias("__g"))
    solved = sums.select(*own, solve_in_order(F.col("__g"), p).alias("__b"))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, own, strict=True)])
    fit = reduce(Column.__add__, [F.col("__b")[i] * F.col(f"__c{i + 1}") for i in range(p)])
    return base.join(solved, same, "left").withColumn(out, F.col("__c0") - fit).drop(*names, *own, "__b")


def zscore(x: str, keys: list[str] | None = None) -> Column:
    """(x - mean) / population deviation; NULL for fewer than two values or a deviation of (nearly) 0."""
    w = Window.partitionBy(*(keys or [DAY]))
    std = F.stddev_pop(x).over(w)
    return F.when((F.count(x).over(w) >= 2) & (std > ZERO), (F.col(x) - F.avg(x).over(w)) / std)


def preprocess_column(df: DataFrame, x: str, mv: str = "mv", industry: str = "industry", keys: list[str] | None = None, n: float = 3.0) -> DataFrame:
    """Clip, neutralise, z-score."""
    return neutralize(clip_column(df, x, keys, n), x, mv, industry, keys).withColumn(x, zscore(x, keys))


def preprocess_wide(df: DataFrame, factors: list[str], mv: str = "mv", industry: str = "industry", n: float = 3.0) -> DataFrame:
    """preprocess_column of several factors within each date, from sums instead of windows: each step is a row of statistics a
    date (or date and industry), which are broadcast, so no task sorts or holds the rows of a date. The rows are written
    once and scanned for each step."""
    rows = parquet_copy(df.withColumns({f: F.col(f).cast("double") for f in factors}), "preprocess")
    number = range(len(factors))

    def attach(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
        own = [f"__k{i}" for i in range(len(keys))]
        stats = F.broadcast(stats.withColumnsRenamed(dict(zip(keys, own, strict=True))))
        return rows.join(stats, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True))), "left").drop(*own)

    def small(stats: DataFrame) -> DataFrame:
        return parquet_copy(stats, "statistics")

    out = attach(rows, small(rows.groupBy(DAY).agg(*(F.median(f).alias(f"__med{i}") for i, f in enumerate(factors)))), [DAY])
    out = attach(out, small(out.groupBy(DAY).agg(*(F.median(F.abs(F.col(f) - F.col(f"__med{i}"))).alias(f"__mad{i}") for i, f in enumerate(factors)))), [DAY])
    log_mv = F.log(F.when(F.col(mv) > 0, F.col(mv)))
    for i, f in enumerate(factors):
        mad, med, width = F.col(f"__mad{i}"), F.col(f"__med{i}"), n * 1.4826 * F.col(f"__mad{i}")
        clipped = F.when(F.coalesce(mad, F.lit(0.0)) == 0, F.col(f)).otherwise(F.when(F.col(f).isNotNull(), cap(f, med - width, med + width)))
        ok = F.coalesce(F.col(f).isNotNull() & (F.col(mv) > 0) & F.col(industry).isNotNull(), F.lit(False))
        out = out.withColumns({f"__y{i}": F.when(ok, clipped), f"__l{i}": F.when(ok, log_mv)})
    means = out.groupBy(DAY, industry).agg(*(F.avg(f"__{v}{i}").alias(f"__{v}m{i}") for v in "yl" for i in number))
    out = attach(out, small(means), [DAY, industry]).withColumns({f"__{v}{i}": F.col(f"__{v}{i}") - F.col(f"__{v}m{i}") for v in "yl" for i in number})
    sums = [s for i in number for s in (F.sum(F.col(f"__l{i}") * F.col(f"__l{i}")).alias(f"__ll{i}"), F.sum(F.col(f"__l{i}") * F.col(f"__y{i}")).alias(f"__ly{i}"), F.count(f"__y{i}").alias(f"__n{i}"))]
    out = attach(out, small(out.groupBy(DAY).agg(*sums)), [DAY])
    for i, f in enumerate(factors):
        beta = F.when(F.col(f"__ll{i}") > ZERO, F.col(f"__ly{i}") / F.col(f"__ll{i}")).otherwise(0.0)
        out = out.withColumn(f, F.when(F.col(f"__n{i}") >= 2, F.col(f"__y{i}") - beta * F.col(f"__l{i}")))
    spread = [s for i, f in enumerate(factors) for s in (F.avg(f).alias(f"__a{i}"), F.stddev_pop(f).alias(f"__s{i}"), F.count(f).alias(f"__c{i}"))]
    out = attach(out, small(out.groupBy(DAY).agg(*spread)), [DAY])
    scaled = {f: F.when((F.col(f"__c{i}") >= 2) & (F.col(f"__s{i}") > ZERO), (F.col(f) - F.col(f"__a{i}")) / F.col(f"__s{i}")) for i, f in enumerate(factors)}
    return out.withColumns(scaled).select(*df.columns)


def preprocess_many(df: DataFrame, factors: list[str], ids: list[str], mv: str = "mv", industry: str = "industry", n: float = 3.0) -> DataFrame:
    """preprocess_wide as a long table (ids, mv, industry, factor, value)."""
    wide = preprocess_wide(df.select(*ids, mv, industry, *factors), factors, mv, industry, n)
    return wide.unpivot([*ids, mv, industry], factors, "factor", "value")


def factor_rank(df: DataFrame, x: str, ascending: bool = True, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{x}_rank", min_rank(x, DAY, ascending))


def composite_score(df: DataFrame, factors: list[tuple[str, bool, float]], out: str = "score") -> DataFrame:
    """Sum of weight * rank over (factor, ascending, weight); the weights are scaled to 1 only if they sum to more. A
    NULL factor makes the score NULL."""
    total = sum(w for _, _, w in factors)
    scale = total if total > 1 else 1.0
    return df.withColumn(out, reduce(Column.__add__, (min_rank(x, DAY, asc) * F.lit(w / scale) for x, asc, w in factors)))


_RULE = re.compile(r"(rank|pct|val):(>=|<=|==|!=|>|<)(-?[0-9.]+)$")


def range_filter(df: DataFrame, rules: list[tuple[str, str] | tuple[str, str, bool]]) -> DataFrame:
    """Keeps rows for which every (factor, rule[, ascending]) holds. Rules: rank:, pct: or val: and a comparison, as
    in pct:<=0.2. Ranks are averages over ties; pct is the rank's share of the non-NULL rows."""
    for i, (x, rule, *asc) in enumerate(rules):
        kind, op, number = _RULE.match(rule.replace(" ", "")).groups()
        up = asc[0] if asc else True
        value = F.col(x) if kind == "val" else avg_rank(x, DAY, up)
        if kind == "pct":
            value = value / F.count(x).over(Window.partitionBy(DAY))
        df = df.withColumn(f"__v{i}", value)
        v, k = F.col(f"__v{i}"), float(number)
        df = df.where({">=": v >= k, "<=": v <= k, "==": v == k, "!=": v != k, ">": v > k, "<": v < k}[op]).drop(f"__v{i}")
    return df


def name_filter(df: DataFrame, min_days: int = 250) -> DataFrame:
    """Drops names with S (so ST too), * or the delisting mark, and codes listed for min_days or less."""
    return df.where(~F.col("name").rlike(r"S|\*|退") & (F.col("listed_days") > min_days))


def drop_blank_dates(df: DataFrame, factors: list[str], last: int = 5) -> DataFrame:
    """Drops those of the last dates on which some factor is missing throughout. The dates are few: their list is made
    first and broadcast."""
    by_date = df.groupBy(DAY).agg(*(F.count(f).alias(f) for f in factors))
    recent = by_date.orderBy(F.desc(DAY)).limit(last)
    blank = recent.where(reduce(Column.__or__, (F.col(f) == 0 for f in factors))).select(DAY)
    return df.join(F.broadcast(blank), DAY, "left_anti")


def latest_full_date(df: DataFrame, factors: list[str]) -> DataFrame:
    """The latest date on which every factor has a value."""
    return df.groupBy(DAY).agg(*(F.count(f).alias(f) for f in factors)).where(reduce(Column.__and__, (F.col(f) > 0 for f in factors))).agg(F.max(DAY).alias(DAY))


def excess_return(ret: str = "next_return") -> Column:
    """Return less the date's equal-weight mean."""
    return F.col(ret) - F.avg(ret).over(Window.partitionBy(DAY))


def cross_factor(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds a factor that is an expression over the whole cross-section (windows by date); rows stay as they are."""
    return df.withColumn(name, expr)


