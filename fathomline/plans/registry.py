"""Every query of the engine by name, with the SQL that its result is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, and its SQL where SQL can express it."""

    def add(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = fn
        if sql:
            _sql[name] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def _load() -> None:
    """Import the modules whose queries register themselves."""
    from . import aggregates, audit, candidates, evaluation, files, functions, grid_rules, guidance, joins, links, paths, records, reports, requests, runs, selection, signal, solvers, stateful, windows  # noqa: F401
