"""Incremental refresh of factors kept per (code, factor)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incremental_plan(state: DataFrame, source: DataFrame, factors: list[str]) -> DataFrame:
    """code_id, factor, action, cut: what each (code, factor) needs. state: code_id, factor, done_max, valid; source:
    code_id, source_max. full: no state, an invalid one, or a source that ends before what was done (rollback); skip:
    nothing newer; incremental: newer bars after done_max. cut is the code's most conservative start: NULL (all) if any of
    its factors is full, else the smallest done_max of those that are incremental."""
    want = source.select("code_id", "source_max", F.explode(F.array(*map(F.lit, factors))).alias("factor"))
    j = want.join(state, ["code_id", "factor"], "left")
    full = F.col("done_max").isNull() | ~F.coalesce("valid", F.lit(False)) | (F.col("source_max") < F.col("done_max"))
    action = F.when(full, "full").when(F.col("source_max") <= F.col("done_max"), "skip").otherwise("incremental")
    w = Window.partitionBy("code_id")
    j = j.withColumn("action", action)
    cut = F.when(F.max((F.col("action") == "full").cast("int")).over(w) == 0, F.min(F.when(F.col("action") == "incremental", F.col("done_max"))).over(w))
    return j.withColumn("cut", cut).select("code_id", "factor", "action", "cut")


def incremental_recompute(bars: DataFrame, cuts: DataFrame, lookback: int, compute: Callable[[DataFrame], DataFrame], key: str = "code_id", ts: str = "trade_date") -> DataFrame:
    """Factor rows after each code's cut (all, where it is NULL), computed from `lookback` rows before it on. cuts: code_id,
    cut; codes that aren't in it are left alone."""
    j = bars.join(cuts, key)
    old = F.col("cut").isNotNull() & (F.col(ts) <= F.col("cut"))
    back = F.row_number().over(Window.partitionBy(key, old).orderBy(F.desc(ts)))
    kept = j.withColumn("__old", old).withColumn("__back", back).where(~F.col("__old") | (F.col("__back") <= lookback)).drop("__back", "__old")
    return compute(kept).where(F.col("cut").isNull() | (F.col(ts) > F.col("cut"))).drop("cut")


def upsert_keep_last(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Union in which a new row replaces an existing one of its key. Of several rows of a key in one table the largest by
    the order columns stays, or by all other columns, so that the winner doesn't depend on partitions. Writing the result
    before the state makes reruns safe: the same batch applied twice gives the same table."""
    both = existing.withColumn("__b", F.lit(0)).unionByName(new.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    rest = [*(order or ()), *(c for c in existing.columns if c not in keys and c not in (order or ()))]
    w = Window.partitionBy(*keys).orderBy(F.desc("__b"), *(F.desc_nulls_last(c) for c in rest))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__b")


def definition_invalidation(state: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """State rows whose factor's definition (expression text) is still the one they were made with: code_hash matches."""
    spark = state.sparkSession
    now = spark.createDataFrame(list(definitions.items()), "factor string, text string").select("factor", F.sha2("text", 256).alias("code_hash"))
    return state.join(F.broadcast(now), ["factor", "code_hash"], "left_semi")
