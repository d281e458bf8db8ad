"""Queries of the engine's own operators, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.plans import conversation_queries, curation_queries, document_queries, evaluation_queries, io_queries, review_queries, selection_queries, stream_queries

_PARTS = (conversation_queries, review_queries, evaluation_queries, document_queries, selection_queries, curation_queries, io_queries, stream_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
