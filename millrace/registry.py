"""Queries of the engine and the SQL that each must equal."""

from __future__ import annotations

from millrace.plans import batch_queries, metric_queries, milestone_queries, source_queries, sync_queries

_PARTS = (sync_queries, batch_queries, metric_queries, milestone_queries, source_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
