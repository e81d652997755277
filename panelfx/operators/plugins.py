"""User extensions: factors, grouped pandas code, rules, signals and sources, found by name in a registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Plugins:
    """factors: name -> f(parameter) -> Column; rules and selections: DataFrame -> DataFrame; signals: as factors, over
    hourly bars; sources: (spark, path) -> DataFrame keyed by (trade_date, code_id)."""

    factors: dict[str, tuple[Callable[..., Column], tuple[str, ...], bool]] = field(default_factory=dict)
    rules: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    signals: dict[str, Callable[..., Column]] = field(default_factory=dict)
    sources: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def factor(self, name: str, needs: tuple[str, ...] = (), cross: bool = False):
        """Registers a factor; needs: the columns it reads; cross: it is an expression over a whole date."""

        def register(fn):
            self.factors[name] = (fn, tuple(needs), cross)
            return fn

        return register

    def _register(self, kind: dict, name: str):
        def register(fn):
            kind[name] = fn
            return fn

        return register

    def rule(self, name: str):
        return self._register(self.rules, name)

    def signal(self, name: str):
        return self._register(self.signals, name)

    def source(self, name: str):
        return self._register(self.sources, name)

    def add_factors(self, panel: DataFrame, wanted: list[tuple[str, object]]) -> DataFrame:
        """Adds the wanted (name, parameter) factors, time-series ones before cross-sectional ones. Rows can't change: a
        factor is a Column."""
        missing = {c for n, _ in wanted for c in self.factors[n][1]} - set(panel.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
        for cross in (False, True):
            cols = {column_name(n, p): self.factors[n][0](p) for n, p in wanted if self.factors[n][2] == cross}
            panel = panel.withColumns(cols) if cols else panel
        return panel

    def apply_rules(self, df: DataFrame, names: list[str]) -> DataFrame:
        for n in names:
            df = df.transform(self.rules[n])
        return df


def column_name(name: str, param=None, minutes: tuple[str, ...] = (), inner: tuple = ()) -> str:
    """name_param_minutes_(inner...): parts that are empty, 0 or False are left out."""
    parts = [name]
    if param:
        parts.append("_".join(map(str, param)) if isinstance(param, (tuple, list)) else str(param))
    if minutes:
        parts.append("_".join(minutes))
    if inner:
        parts.append("(" + ",".join(column_name(*i) if isinstance(i, tuple) else str(i) for i in inner) + ")")
    return "_".join(parts)


def column_names(name: Column, param: Column, minutes: Column, inner: Column) -> Column:
    """As column_name, over columns of parts; NULL parts are left out."""
    return F.concat_ws("_", name, param, minutes, inner)


def setting_name(factor: str, param: str, minutes: str, inner: str) -> Column:
    """column_name over columns of a settings table: parameters that are empty, 0 or NULL are left out, the inner field is in
    brackets."""
    part = lambda c: F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "false", "0.0"), F.col(c).cast("string"))
    return column_names(F.col(factor), part(param), part(minutes), F.concat(F.lit("("), part(inner), F.lit(")")))


def grouped_plugin(panel: DataFrame, fn, schema: str, key: str = "code_id") -> DataFrame:
    """Arbitrary pandas code for each code's history (a few thousand rows), for what expressions can't say."""
    return panel.groupBy(key).applyInPandas(fn, schema)
