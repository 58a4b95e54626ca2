"""All registered queries of the library and their SQL."""

from __future__ import annotations

from lakesift.plans import corpus_queries, search_queries, store_queries


def queries() -> dict:
    return store_queries.QUERIES | search_queries.QUERIES | corpus_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return store_queries.SQL | search_queries.SQL | corpus_queries.SQL
