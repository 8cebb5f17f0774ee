"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import area_queries, change_queries, more_queries, rollup_queries, spatial_queries

_ALL = rollup_queries.QUERIES | spatial_queries.QUERIES | more_queries.QUERIES | change_queries.QUERIES | area_queries.QUERIES
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql}
