"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    its oracle over the driver tables (derived views are added as CTEs)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql)
        fn.query_name = name
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import behavior, dashboard, enrichment, extras, features, graph, ingest, lifecycle, maintenance, ml, pipelines, predictions, streams  # noqa: F401
