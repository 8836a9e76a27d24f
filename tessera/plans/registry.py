"""Registry of named queries: Spark builder + independent DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
driver tables.  The oracle is written separately in plain SQL (DuckDB dialect)
so it cross-checks the Spark plan rather than restating it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def _load_all() -> None:
    # Import the plan modules for their registration side effect.
    from tessera.plans import (  # noqa: F401
        cards_plans, complete_plans, corpus_plans, news_plans, notes_plans, queue_plans,
        source_plans, speech_plans, stream_plans)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
