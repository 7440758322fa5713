"""Queries on the general data-processing problems (incremental work, orphan references, skewed keys), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import heavy, ledger, orphans
from lodestone.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Current versions that the ledger holds as pending: what the next run must handle."""
    return ledger.file_states(spark, root).where(F.col("state") == ledger.PENDING).select("path", "content_hash")


def p2_ledger(spark: SparkSession, root: str) -> DataFrame:
    """State of every current version with the fencing token that decided it."""
    return ledger.file_states(spark, root).select("path", "content_hash", "state", "token")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_records(orphans.graph_orphans(spark, root))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table, field and month."""
    return orphans.orphan_report(orphans.graph_orphans(spark, root))


def _keyed(spark: SparkSession, root: str) -> list[tuple[str, DataFrame, str]]:
    e = table(spark, root, "edges").select("to_unresolved", "kind", "from_fqdn", "recorded_ms")
    c = table(spark, root, "call_sites").select("callee_text", "from_fqdn", "recorded_ms")
    return [("edges.to_unresolved", e, "to_unresolved"), ("edges.kind", e, "kind"), ("call_sites.callee_text", c, "callee_text")]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _union([heavy.heavy_keys(df, key).select(F.lit(name).alias("field_name"), F.col(key).alias("key_value")) for name, df, key in _keyed(spark, root)])


def p6_per_key(spark: SparkSession, root: str) -> DataFrame:
    """Rows, distinct from_fqdn, first and last recorded_ms of every value of the three fields."""
    return _union([
        heavy.per_key(df, key, "from_fqdn", "recorded_ms").select(F.lit(name).alias("field_name"), F.col(key).alias("key_value"), "rows", "members", "first_ms", "last_ms")
        for name, df, key in _keyed(spark, root)
    ])


QUERIES = {f.__name__: f for f in (p2_found, p2_ledger, p5_found, p5_report, p6_found, p6_per_key)}

_CANON = "regexp_replace(regexp_replace(regexp_replace(trim(path), '\\\\', '/', 'g'), '/(?:\\./|/)+', '/', 'g'), '^((?:\\./)*)(ws:[^:/]*:)?(?:\\./)*', '\\2')"
_P2 = f"""
WITH cur AS (
  SELECT {_CANON} AS item, path, content_hash,
         row_number() OVER (PARTITION BY {_CANON} ORDER BY last_scanned_ms DESC, content_hash DESC, path DESC) AS rn
  FROM files WHERE path IS NOT NULL),
done AS (
  SELECT {_CANON} AS item, lower(trim(p.content_hash)) AS version, p.run_id AS token,
         row_number() OVER (PARTITION BY {_CANON} ORDER BY p.run_id DESC, p.processed_ms DESC, lower(trim(p.content_hash)) DESC) AS rn
  FROM processed_files p
  WHERE p.path IS NOT NULL
    AND p.run_id IN (SELECT run_id FROM scan_runs WHERE status = 'succeeded')),
st AS (
  SELECT c.path, c.content_hash, coalesce(d.version = lower(trim(c.content_hash)), false) AS is_done, d.token
  FROM cur c LEFT JOIN (SELECT * FROM done WHERE rn = 1) d ON c.item = d.item WHERE c.rn = 1)
"""
_P5 = """
WITH live AS (SELECT DISTINCT workspace_id, fqdn, symbol_id FROM symbols WHERE deleted_ms IS NULL),
orphan AS (
  SELECT 'edges' AS table_name, edge_id AS record_id, 'from_fqdn' AS field_name, from_fqdn AS k, recorded_ms FROM edges e
   WHERE from_fqdn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live s WHERE s.fqdn = e.from_fqdn AND s.workspace_id = e.workspace_id)
  UNION ALL
  SELECT 'edges', edge_id, 'to_symbol_id', CAST(to_symbol_id AS VARCHAR), recorded_ms FROM edges e
   WHERE to_symbol_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live s WHERE s.symbol_id = e.to_symbol_id)
  UNION ALL
  SELECT 'edges', edge_id, 'to_unresolved', to_unresolved, recorded_ms FROM edges e
   WHERE contains(to_unresolved, '::') AND NOT EXISTS (SELECT 1 FROM live s WHERE s.fqdn = e.to_unresolved AND s.workspace_id = e.workspace_id)
  UNION ALL
  SELECT 'call_sites', id, 'from_fqdn', from_fqdn, recorded_ms FROM call_sites c
   WHERE from_fqdn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live s WHERE s.fqdn = c.from_fqdn))
"""
_FIELDS = (("edges", "to_unresolved"), ("edges", "kind"), ("call_sites", "callee_text"))

SQL = {
    "p2_found": _P2 + "SELECT path, content_hash FROM st WHERE NOT is_done",
    "p2_ledger": _P2 + "SELECT path, content_hash, CASE WHEN is_done THEN 'done' ELSE 'pending' END AS state, CASE WHEN is_done THEN token END AS token FROM st",
    "p5_found": _P5 + "SELECT DISTINCT table_name, record_id, field_name FROM orphan",
    "p5_report": _P5 + """, once AS (SELECT table_name, field_name, record_id, min(recorded_ms) AS ms, min(k) AS k FROM orphan GROUP BY ALL)
SELECT table_name, field_name, strftime(epoch_ms(ms), '%Y-%m') AS period, count(*) AS orphans, count(DISTINCT k) AS missing_keys FROM once GROUP BY ALL""",
    "p6_found": "\nUNION ALL\n".join(
        f"SELECT '{t}.{c}' AS field_name, {c} AS key_value FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) >= 0.02 * (SELECT count({c}) FROM {t})" for t, c in _FIELDS),
    "p6_per_key": "\nUNION ALL\n".join(
        f"SELECT '{t}.{c}' AS field_name, {c} AS key_value, count(*) AS \"rows\", count(DISTINCT from_fqdn) AS members, min(recorded_ms) AS first_ms, max(recorded_ms) AS last_ms FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}"
        for t, c in _FIELDS),
}
