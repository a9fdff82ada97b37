"""All queries of the core library by name, with their DuckDB counterparts."""

from __future__ import annotations

from tessera.plans import graph_queries, index_queries, search_queries, source_queries, text_queries, usage_queries

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (search_queries, index_queries, graph_queries, usage_queries, text_queries, source_queries):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
