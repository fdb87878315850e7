"""The registry of checked queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, extraction_queries, index_queries, retrieval_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {
    **text_queries.QUERIES,
    **extraction_queries.QUERIES,
    **retrieval_queries.QUERIES,
    **evaluation_queries.QUERIES,
    **index_queries.QUERIES,
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ENTRIES.items() if text}
