"""All queries of the engine and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) as a query, with its oracle SQL where SQL can state it."""

    def add(f):
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    from tidewell.plans import (  # noqa: F401
        affected,
        calendar,
        candidates,
        captured,
        documents,
        evidence,
        formats,
        gates,
        graphs,
        intervals,
        ledger,
        matrices,
        profiles,
        records,
        runs,
        scalars,
        scrubbing,
        stored,
        windows,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["agg_yield"](spark, sf_dir)
