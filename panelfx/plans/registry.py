"""Collects the registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of Tables as a query, and DuckDB SQL (over tables and views) for its rows."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def six(expr: str, places: int = 6) -> str:
    """SQL for a double at `places` places, as functions.r6."""
    return f"floor(({expr}) * 1e{places} + 0.5) / 1e{places}"
