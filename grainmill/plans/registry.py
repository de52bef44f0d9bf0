"""Registered queries of the library: name, DataFrame form and SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "decontam_by_lang"

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state it, the SQL that gives the same rows."""

    def keep(run: Query) -> Query:
        _queries[name] = run
        if sql is not None:
            _sql[name] = sql
        return run

    return keep


def _load() -> None:
    import grainmill.plans.catalog  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
