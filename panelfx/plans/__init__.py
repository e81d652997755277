"""Registered queries of the factor engine, one module for each group of operators."""

from .registry import ORACLES, QUERIES
import importlib
import pkgutil

for _m in pkgutil.iter_modules(__path__):
    importlib.import_module(f"{__name__}.{_m.name}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
