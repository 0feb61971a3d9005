"""Registry of the queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_loaded = False


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    global _loaded
    if not _loaded:
        from traceframe import library  # noqa: F401

        _loaded = True


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracles() -> dict[str, str]:
    _load()
    return _oracles
