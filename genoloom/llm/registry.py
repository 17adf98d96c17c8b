"""All queries of this subpackage."""

from __future__ import annotations

from genoloom.llm import entity_queries, leak_queries, packing_queries, subject_queries, sumstats_queries

_PARTS = (entity_queries, sumstats_queries, packing_queries, leak_queries, subject_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL = {k: s for part in _PARTS for k, s in part.SQL.items()}
