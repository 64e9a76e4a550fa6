"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import io_queries, model_queries, nested_queries, qa_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return qa_queries.QUERIES | model_queries.QUERIES | nested_queries.QUERIES | io_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return qa_queries.SQL | model_queries.SQL | nested_queries.SQL | io_queries.SQL
