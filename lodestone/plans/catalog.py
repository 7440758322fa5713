"""All queries of the core and their SQL."""

from __future__ import annotations

from lodestone.plans import case_queries, data_queries, extract_queries, graph_queries, lookup_queries, maintenance_queries, resolve_queries, storage_queries

MODULES = [data_queries, lookup_queries, graph_queries, resolve_queries, maintenance_queries, extract_queries, storage_queries, case_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
