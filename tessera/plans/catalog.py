"""All registered queries of the engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import coverage_queries, export_queries, index_queries, knowledge_queries, listing_queries, page_queries, report_queries, rule_queries, store_queries, stream_queries, text_queries, update_queries, vector_queries, wiki_queries

MODULES = (listing_queries, text_queries, report_queries, wiki_queries, rule_queries, index_queries, stream_queries, vector_queries, coverage_queries, page_queries, store_queries, knowledge_queries, export_queries, update_queries)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
