"""The registered queries of the library and, where SQL can say them, their DuckDB twins."""

from __future__ import annotations

from loomwright.plans import content_queries, registry, retrieval_queries, social_queries, task_queries, text_queries  # noqa: F401

FLAGSHIP = "hybrid_search"


def queries() -> dict:
    return registry.QUERIES


def oracle_sql() -> dict:
    return registry.ORACLES
