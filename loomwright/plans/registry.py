"""How a query is registered: its operator over named views, and its DuckDB twin over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwright.sources.adapters import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str | None = None):
    """Registers a function of DataFrames (``views``, in order) as query ``name``."""
    names = views.split()

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, n) for n in names])
        if sql is not None:
            given = [n for n in names if n not in ("orders", "lineitem", "customer", "events", "documents", "embeddings", "conversations", "benchmark")]
            ORACLES[name] = with_views(sql, *dict.fromkeys(given)) if given else sql
        return build

    return keep
