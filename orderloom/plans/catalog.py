"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import document_queries, order_queries, other_queries

GROUPS = (order_queries, document_queries, other_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for g in GROUPS for n, f in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for g in GROUPS for n, s in g.SQL.items()}
