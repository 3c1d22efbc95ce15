"""All queries of the engine by name, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where SQL expresses it."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for name in ("text_queries", "lexical_queries", "neighborhood_queries", "bridge_queries", "proposal_queries", "method_queries", "paper_queries", "corpus_queries", "evaluation_queries", "assessment_queries", "replay_queries", "idea_queries", "graph_queries", "retrieval_queries", "decision_queries", "stream_queries", "source_queries", "classify_queries", "composite_queries", "mutation_queries", "json_queries", "mechanism_queries"):
        import_module(f"quillgraph.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
