"""Catalog of registered queries: name -> (Spark callable, optional oracle SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("rows", "census", "similar", "scores", "censor", "learn")


def query(name: str, oracle: str | None = None):
    """Registers `fn(spark, sf_dir)` under `name`, with the SQL that must give the same rows."""
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return register


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__package__}.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
