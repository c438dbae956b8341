"""Queries of the integrity engine by name, with the DuckDB SQL that states each."""

from __future__ import annotations

from candela.plans import analysis_queries, analysis_sql, detail_queries, feed_queries, feed_sql, rule_queries, temporal_queries

MODULES = [temporal_queries, analysis_queries, detail_queries, feed_queries, rule_queries]
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in (temporal_queries, analysis_sql, detail_queries, feed_sql, rule_queries) for name, sql in m.ORACLE_SQL.items()}
