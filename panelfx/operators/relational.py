"""Plain building blocks: thin, so that queries read alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order))
    return df.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def agg_group(df: DataFrame, keys: list[str], x: str, order: str) -> DataFrame:
    """mean, sum, n, std, min, max, first, last (by order) and nunique of x."""
    return df.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.sum(x).alias("sum"), F.count(x).alias("n"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.min_by(x, order).alias("first"), F.max_by(x, order).alias("last"), F.count_distinct(x).alias("nunique"),
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__k") <= k).drop("__k")


def concat_tables(*tables: DataFrame) -> DataFrame | None:
    """Union by name of tables whose columns may differ; those without any column are left out."""
    tables = [t for t in tables if t is not None and t.columns]
    out = tables[0] if tables else None
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
