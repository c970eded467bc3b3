"""All named queries of the core and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomill.plans import answer_queries, corpus_queries, source_queries

FLAGSHIP = "parsed_quality_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return corpus_queries.QUERIES | answer_queries.QUERIES | source_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return corpus_queries.SQL | answer_queries.SQL | source_queries.SQL
