"""Queries and their SQL, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

#: Shared first parts of the SQL: live symbols, current files, edges and calls once each, edges with their target.
LIVE = """live AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id, fqdn ORDER BY indexed_ms DESC, last_modified_revision DESC, symbol_id DESC) AS rn FROM symbols) WHERE rn = 1 AND deleted_ms IS NULL)"""
CUR = """cur AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY last_scanned_ms DESC, content_hash DESC, byte_size DESC) AS rn FROM files) WHERE rn = 1)"""
EDGE = """e1 AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY recorded_ms) = 1)"""
CALL = """c1 AS (SELECT * FROM call_sites QUALIFY row_number() OVER (PARTITION BY id ORDER BY recorded_ms) = 1)"""
GRAPH = f"""{LIVE}, {EDGE}, g AS (SELECT e.*, l.fqdn IS NOT NULL AS resolved, coalesce(l.fqdn, e.to_unresolved, e.to_fqdn) AS target FROM e1 e LEFT JOIN (SELECT symbol_id AS sid, fqdn FROM live) l ON e.to_symbol_id = l.sid)"""


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return add
