"""Registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import invariant_queries, market_queries, page_queries, report_queries, scan_queries, table_queries

_MODULES = (market_queries, page_queries, table_queries, report_queries, scan_queries, invariant_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_queries.ranked_pages(spark, sf_dir)
