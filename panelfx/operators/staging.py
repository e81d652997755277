"""Staged entry of strategies that run in offsets, on holding intervals.

A code is held from the date at which it is selected until no stage's latest selection has it: an interval of the
strategy's dates. All codes held on a date are scaled by one factor, and all codes that enter on a date get one share. So
what a date's recurrence needs of the codes is how many enter and leave when: counts by (entry, exit). It runs over those
counts; codes get their shares back by a join on their entry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "code_id"


def strategy_dates(selections: DataFrame) -> DataFrame:
    """strategy, select_date, k (place among the strategy's dates, from 0), stages (filled so far), last (dates in all)."""
    first = selections.groupBy("strategy", "stage").agg(F.min("select_date").alias("select_date"))
    new = first.groupBy("strategy", "select_date").agg(F.count("*").alias("new"))
    by = Window.partitionBy("strategy").orderBy("select_date")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    days = selections.select("strategy", "select_date").distinct().join(new, ["strategy", "select_date"], "left")
    return days.select(
        "strategy", "select_date", (F.row_number().over(by) - 1).alias("k"),
        F.sum(F.coalesce("new", F.lit(0))).over(upto).alias("stages"),
        F.count("*").over(Window.partitionBy("strategy")).alias("last"),
    )


def holding_intervals(selections: DataFrame) -> DataFrame:
    """strategy, code_id, entry, exit: the code is held on the strategy's dates entry, ..., exit - 1. selections: strategy,
    select_date, stage, code_id; a stage's selection counts until the stage's next date. Intervals of several stages that
    overlap or follow on each other are one."""
    days = strategy_dates(selections)
    rows = selections.select("strategy", "select_date", "stage", KEY).distinct()
    by_stage = Window.partitionBy("strategy", "stage").orderBy("k")
    spans = (
        rows.select("strategy", "select_date", "stage").distinct().join(days, ["strategy", "select_date"])
        .select("strategy", "select_date", "stage", "k", F.coalesce(F.lead("k").over(by_stage), "last").alias("until"))
    )
    own = Window.partitionBy("strategy", KEY).orderBy("k", "until")
    before = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.join(spans, ["strategy", "select_date", "stage"])
    parts = parts.withColumn("apart", F.when(F.col("k") <= before, 0).otherwise(1))
    parts = parts.withColumn("run", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = parts.groupBy("strategy", KEY, "run").agg(F.min("k").alias("entry"), F.max("until").alias("exit"))
    return merged.drop("run")


def fold_shares(entry: np.ndarray, leave: np.ndarray, n: np.ndarray, totals: np.ndarray) -> list[tuple[int, int, float]]:
    """(entry, date, share of each code that entered then) for all dates at which such codes are held. n codes are held on
    the dates entry, ..., leave - 1; totals: each date's target. If more is held than the target, all shares are scaled
    down to it; the rest up to the target is split among the codes that enter."""
    dates = len(totals)
    alive, share, out = np.zeros(dates), np.zeros(dates), []
    enters, leaves = np.argsort(entry, kind="stable"), np.argsort(leave, kind="stable")
    i = j = 0
    for k in range(dates):
        while j < len(leaves) and leave[leaves[j]] <= k:
            alive[entry[leaves[j]]] -= n[leaves[j]]
            j += 1
        held = np.flatnonzero(alive[:k])
        now = float(alive[held] @ share[held])
        if now > totals[k]:
            share[held] *= totals[k] / now
            now = totals[k]
        while i < len(enters) and entry[enters[i]] == k:
            alive[k] += n[enters[i]]
            i += 1
        if alive[k]:
            share[k] = (totals[k] - now) / alive[k]
            held = np.append(held, k)
        out += [(int(e), k, float(share[e])) for e in held]
    return out


def staged_entry(selections: DataFrame, targets: list[float]) -> DataFrame:
    """strategy, select_date, code_id, share from selections: strategy, select_date, stage, code_id. On each date the codes
    of that date's stages are new entries: codes that no stage selects any more leave at once; codes that stay are scaled
    down if more is held than the target; the rest up to the date's target (targets[stages filled so far - 1], the last
    one from then on) is split among the codes that weren't held. Repeated rows count once.

    Only counts by (entry, exit) of a strategy are folded, at most half the square of its dates whatever the number of
    codes; the codes' own rows are spread by (strategy, code)."""
    import pandas as pd

    days = strategy_dates(selections)
    intervals = holding_intervals(selections)
    target: Column = F.element_at(F.array(*[F.lit(float(x)) for x in targets]), F.least("stages", F.lit(len(targets))).cast("int"))
    cohorts = intervals.groupBy("strategy", "entry", "exit").agg(F.count("*").alias("n"))
    at_entry = cohorts.select("strategy", F.col("entry").alias("k"), "exit", "n", F.lit(None).cast("double").alias("target"))
    at_date = days.select("strategy", "k", F.lit(None).cast("int").alias("exit"), F.lit(None).cast("long").alias("n"), target.alias("target"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        dates, moves = g[g["target"].notna()].sort_values("k"), g[g["target"].isna()]
        entry, leave, n = (moves[c].to_numpy().astype(np.int64) for c in ("k", "exit", "n"))
        out = pd.DataFrame(fold_shares(entry, leave, n, dates["target"].to_numpy()), columns=["entry", "k", "share"])
        out.insert(0, "strategy", g["strategy"].iloc[0])
        return out

    shares = at_entry.unionByName(at_date).groupBy("strategy").applyInPandas(fold, "strategy string, entry int, k int, share double")
    held = intervals.join(shares, ["strategy", "entry"]).where("k < exit")
    return held.join(days.select("strategy", "k", "select_date"), ["strategy", "k"]).select("strategy", "select_date", KEY, "share")
