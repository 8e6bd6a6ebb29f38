"""Registry of named queries and their DuckDB oracle SQL.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Its oracle is an
independent SQL formulation over the same parquet tables (tables registered
as views by the checker), used for the correctness gate.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_MODULES = (
    "textlens.plans.q_knowledge",
    "textlens.plans.q_metrics",
    "textlens.plans.q_text",
    "textlens.plans.q_triples",
    "textlens.plans.q_entities",
    "textlens.plans.q_kb",
    "textlens.plans.q_graph",
    "textlens.plans.q_sources",
    "textlens.plans.q_vectors",
    "textlens.plans.q_models",
    "textlens.plans.q_streams",
)


def query(name: str, oracle: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def _load() -> None:
    for m in _MODULES:
        try:
            importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name != m:
                raise


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracles() -> dict[str, str]:
    _load()
    return dict(sorted(_ORACLES.items()))
