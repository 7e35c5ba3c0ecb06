"""All queries of the core, with their SQL."""

from __future__ import annotations

from . import content_queries, entity_queries, export_queries, fold_queries, interval_queries, record_queries, relational_queries, retrieval_queries, scalar_queries

_PARTS = [interval_queries, scalar_queries, retrieval_queries, relational_queries, fold_queries, entity_queries, record_queries, content_queries, export_queries]
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in _PARTS for name, text in part.SQL.items()}
FLAGSHIP = "r7_fused_search"
