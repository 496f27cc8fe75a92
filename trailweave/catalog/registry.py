"""Registry of named queries and their check SQL."""
from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from trailweave.catalog.oracle_views import with_views
from trailweave.session import fit_partitions
from trailweave.sources.fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORIGIN: dict[str, str] = {}

MODULES = ["base", "cleaning", "aggregates", "sequences", "engines", "fusion", "ranking", "journeys", "multi", "offline", "tuning"]


_TABLES: dict[tuple[str, str], Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """One table set per session and folder, so feature tables written once are shared by the queries."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _TABLES:
        fit_partitions(spark, sf_dir)
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tables_for(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        ORIGIN[name] = fn.__module__.rsplit(".", 1)[-1]
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def shared(fn):
    """Keep the result of ``fn(tables)`` on the table set: intermediate tables used by several queries."""

    def once(t: Tables):
        cache = t.__dict__.setdefault("_shared", {})
        if fn not in cache:
            cache[fn] = fn(t)
        return cache[fn]

    return once


def load_all() -> None:
    for m in MODULES:
        import_module(f"trailweave.catalog.{m}")


def oracle_texts() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}
