"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callflow.catalog.views import Tables, oracle

MODULES = ["alignment", "documents", "files", "operations", "requests", "sound", "text"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "", **extra: str):
    """Register ``fn(tables)`` under ``name``; ``needs`` lists the views of its SQL."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise KeyError(name)
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = oracle(sql, *needs.split(), **extra)
        return fn

    return wrap


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"callflow.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
