"""Registered queries of the annotation library and their oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from annoflux.plans.views import duck

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_MODULES = ("sequence", "discovery", "evidence", "interpret", "reports", "files")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query with its DuckDB SQL, if there is one."""

    def keep(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _oracles[name] = duck(sql, *views) if views else sql
        return f

    return keep


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"annoflux.plans.queries_{module}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each genome, predicted genes by support: high, moderate, low, dark."""
    _load()
    return _queries["w1_genome_support"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
