"""Driver queries: incremental maintenance, ignore rules, storage, streaming (operators O-03 to O-08, O-69, O-70, O-119 to O-151)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import incremental as inc
from lodestone.plans.registry import CALL, CUR, EDGE, LIVE, Registry
from lodestone.session import shared_dir
from lodestone.sources import workspace
from lodestone.sources.tables import current_files, distinct_calls, distinct_edges, live_symbols, table
from lodestone.streaming import live as stream

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

#: Two states of the ignore rules, and the point in time that diffs look back to.
BEFORE = [("", ["node_modules/", "*.min.js", "/scripts/"]), ("packages/viewport", ["dist/"])]
AFTER = [("", ["node_modules/", "*.min.js", "*.bundle.js", "vendor/"]), ("packages/palette", ["!vendor/"])]
LOOK_BACK_MS = 1_767_225_600_000


def _rx(base: str, pattern: str, folder: bool) -> str:
    return "^" + (base + "/" if base else "") + "(?:.*/)?" + pattern + ("/.*" if folder else "(?:/.*)?") + "$"


_A = f"(regexp_matches(path, '{_rx('', 'node_modules', True)}') OR regexp_matches(path, '{_rx('', '[^/]*[.]min[.]js', False)}') OR regexp_matches(path, '^scripts/.*$') OR regexp_matches(path, '{_rx('packages/viewport', 'dist', True)}'))"
_B = f"CASE WHEN regexp_matches(path, '{_rx('packages/palette', 'vendor', True)}') THEN false ELSE regexp_matches(path, '{_rx('', 'node_modules', True)}') OR regexp_matches(path, '{_rx('', '[^/]*[.]min[.]js', False)}') OR regexp_matches(path, '{_rx('', '[^/]*[.]bundle[.]js', False)}') OR regexp_matches(path, '{_rx('', 'vendor', True)}') END"
# A leading slash anchors "/scripts/", so its pattern has no free prefix.


@query(f"SELECT DISTINCT path, {_A} AS ignored FROM files")
def o03_ignored(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "files").select("path").distinct()
    return p.select("path", inc.ignored(F.col("path"), BEFORE).alias("ignored"))


@query("WITH m AS (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(?:.*/)?[^/]*_[^/]*[.]ts(?:/.*)?$')) SELECT path, (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) > 10 AS truncated FROM m ORDER BY path LIMIT 10")
def o04_pattern_preview(spark: SparkSession, root: str) -> DataFrame:
    return inc.preview(table(spark, root, "files").select("path"), "path", "*_*.ts", 10)


@query(f"WITH {CUR}, p AS (SELECT path, content_hash, last_scanned_ms FROM files), o AS (SELECT p.path, max_by(p.content_hash, p.last_scanned_ms) AS old_hash FROM p JOIN cur c ON c.path = p.path AND p.last_scanned_ms < c.last_scanned_ms GROUP BY p.path) SELECT c.path, c.content_hash, CASE WHEN o.old_hash IS NULL THEN 'new' WHEN o.old_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM cur c LEFT JOIN o USING (path)")
def o05_hash_skip(spark: SparkSession, root: str) -> DataFrame:
    """Is the current version of a path new, changed or unchanged against the version before it?"""
    f = table(spark, root, "files").select("path", "content_hash", "last_scanned_ms").distinct()
    c = current_files(spark, root, "content_hash", "last_scanned_ms").select("path", "content_hash", "last_scanned_ms")
    prev = f.withColumnsRenamed({"content_hash": "h", "last_scanned_ms": "ms"}).join(c, "path").where("ms < last_scanned_ms").groupBy("path").agg(F.max_by("h", "ms").alias("old"))
    return c.join(prev, "path", "left").select("path", "content_hash", F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("content_hash"), "unchanged").otherwise("changed").alias("state"))


@query("WITH old AS (SELECT workspace_id, fqdn, max_by(body_hash, indexed_ms) AS body_hash FROM symbols WHERE indexed_ms <= 1767225600000 GROUP BY ALL), new AS (SELECT workspace_id, fqdn, max_by(body_hash, indexed_ms) AS body_hash FROM symbols WHERE indexed_ms > 1767225600000 GROUP BY ALL) SELECT coalesce(n.workspace_id, o.workspace_id) AS workspace_id, coalesce(n.fqdn, o.fqdn) AS fqdn, CASE WHEN n.fqdn IS NOT NULL THEN n.body_hash ELSE o.body_hash END AS body_hash FROM old o FULL JOIN new n ON o.workspace_id = n.workspace_id AND o.fqdn = n.fqdn")
def o07_upsert_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Rows indexed after a point in time written over those before it, by (workspace, name)."""
    s = table(spark, root, "symbols")

    def half(cond: str) -> DataFrame:
        # max_by keeps a null body hash of the latest row, as the writer would.
        return s.where(cond).groupBy("workspace_id", "fqdn").agg(F.max_by(F.struct("body_hash"), "indexed_ms").alias("r")).select("workspace_id", "fqdn", "r.body_hash")

    return inc.upsert(half(f"indexed_ms <= {LOOK_BACK_MS}"), half(f"indexed_ms > {LOOK_BACK_MS}"), ["workspace_id", "fqdn"])


@query(f"WITH {CUR}, f AS (SELECT path, max(project_id) AS first_project FROM files GROUP BY path) SELECT c.path, c.content_hash, coalesce(f.first_project, c.project_id) AS project_id FROM cur c JOIN f USING (path)")
def o08_upsert_files(spark: SparkSession, root: str) -> DataFrame:
    """Current versions written over all older ones; a project once set stays."""
    f = table(spark, root, "files")
    c = current_files(spark, root, "content_hash", "project_id").select("path", "content_hash", "project_id")
    old = f.groupBy("path").agg(F.max("project_id").alias("project_id")).select("path", F.lit(None).cast("string").alias("content_hash"), "project_id")
    return inc.upsert(old, c, ["path"], keep=("project_id",))


_STATE = "SELECT * FROM (SELECT * FROM symbols {w} QUALIFY row_number() OVER (PARTITION BY workspace_id, fqdn ORDER BY indexed_ms DESC, last_modified_revision DESC, symbol_id DESC) = 1) WHERE deleted_ms IS NULL"


@query(f"""WITH a AS ({_STATE.format(w='WHERE indexed_ms <= 1767225600000')}), b AS ({_STATE.format(w='')}) SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(a.fqdn, b.fqdn) AS fqdn,
CASE WHEN a.fqdn IS NULL THEN 'insert' WHEN b.fqdn IS NULL THEN 'delete' WHEN a.body_hash IS DISTINCT FROM b.body_hash THEN 'modify' WHEN (a.start_line, a.start_col, a.end_line, a.end_col) IS DISTINCT FROM (b.start_line, b.start_col, b.end_line, b.end_col) THEN 'position' ELSE 'same' END AS change FROM a FULL JOIN b ON a.workspace_id = b.workspace_id AND a.fqdn = b.fqdn""")
def o69_symbol_diff(spark: SparkSession, root: str) -> DataFrame:
    """Live symbols now against those of a point in time."""
    s = table(spark, root, "symbols").where(F.col("indexed_ms") <= LOOK_BACK_MS)
    cols = ["body_hash", "start_line", "start_col", "end_line", "end_col", "deleted_ms"]
    then = s.groupBy("workspace_id", "fqdn").agg(F.max_by(F.struct(*cols), F.struct("indexed_ms", "last_modified_revision", "symbol_id")).alias("r")).select("workspace_id", "fqdn", "r.*").where("deleted_ms is null")
    return inc.diff(then, live_symbols(spark, root, "body_hash", "start_line", "start_col", "end_line", "end_col"), ["workspace_id", "fqdn"])


@query(f"WITH x AS (SELECT DISTINCT path, {_A} AS a, {_B} AS b FROM files) SELECT path, CASE WHEN b THEN 'newly_excluded' ELSE 'newly_allowed' END AS change FROM x WHERE a <> b")
def o70_filter_change(spark: SparkSession, root: str) -> DataFrame:
    return inc.filter_change(table(spark, root, "files").select("path"), "path", BEFORE, AFTER)


@query(f"WITH {CUR} SELECT path, content_hash, language, last_scanned_ms FROM cur")
def o119_stream_files(spark: SparkSession, root: str) -> DataFrame:
    """All file versions streamed in and folded to the current ones, one micro-batch after another."""
    schema = table(spark, root, "files").select("path", "content_hash", "language", "last_scanned_ms").schema
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.follow(spark, f"{root}/files*.parquet", schema, base, ["path"], ["last_scanned_ms", "content_hash"], max_files=8, trigger={"availableNow": True})
    q.awaitTermination()
    return stream.snapshot(spark, base, schema)


@query(f"WITH {LIVE} SELECT workspace_id, max(last_modified_revision) AS revision, count(*) AS symbols FROM live GROUP BY workspace_id")
def o122_revisions(spark: SparkSession, root: str) -> DataFrame:
    return live_symbols(spark, root, "last_modified_revision").groupBy("workspace_id").agg(F.max("last_modified_revision").alias("revision"), F.count("*").alias("symbols"))


@query(f"WITH {LIVE}, r AS (SELECT DISTINCT symbol_fqdn AS fqdn FROM raw_documents WHERE symbol_fqdn IS NOT NULL), s AS (SELECT fqdn, max(last_modified_revision) AS rev FROM live GROUP BY fqdn) SELECT r.fqdn, CAST(6000 AS BIGINT) AS fetched_at, CASE WHEN rev IS NULL THEN 'missing' WHEN rev > 6000 THEN 'stale' ELSE 'fresh' END AS state FROM r LEFT JOIN s USING (fqdn)")
def o123_staleness(spark: SparkSession, root: str) -> DataFrame:
    """Documented names fetched at revision 6000: missing, stale or fresh now."""
    r = table(spark, root, "raw_documents").where("symbol_fqdn is not null").select(F.col("symbol_fqdn").alias("fqdn"), F.lit(6000).cast("bigint").alias("fetched_at")).distinct()
    return inc.staleness(r, live_symbols(spark, root, "last_modified_revision"))


@query(f"WITH {LIVE} SELECT source_origin, count(*) AS kept FROM live WHERE NOT (coalesce(is_external, false) AND coalesce(source_origin, '') = 'cargo_registry') GROUP BY ALL")
def o124_purge_externals(spark: SparkSession, root: str) -> DataFrame:
    """What stays when a lockfile change purges one origin's external symbols."""
    gone = F.coalesce("is_external", F.lit(False)) & (F.coalesce("source_origin", F.lit("")) == "cargo_registry")
    return live_symbols(spark, root, "is_external", "source_origin").where(~gone).groupBy("source_origin").agg(F.count("*").alias("kept"))


@query(f"WITH {CUR}, g AS (SELECT path, max_by(content_hash, last_scanned_ms) AS good_hash FROM files WHERE coalesce(last_scan_error, '') = '' GROUP BY path) SELECT c.path, c.content_hash, c.last_scan_error AS error, g.good_hash FROM cur c LEFT JOIN g USING (path) WHERE coalesce(c.last_scan_error, '') <> ''")
def o126_last_good(spark: SparkSession, root: str) -> DataFrame:
    return inc.last_good(table(spark, root, "files").select("path", "content_hash", "last_scan_error", "last_scanned_ms"))


@query("WITH s AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), d AS (SELECT DISTINCT user_id, sec FROM s), l AS (SELECT user_id, sec, lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS p FROM d) SELECT s.event_id, s.user_id, coalesce(l.p >= s.sec - 300, false) AS recent FROM s JOIN l USING (user_id, sec)")
def o128_recent_use(spark: SparkSession, root: str) -> DataFrame:
    """Events whose user was active in the 300 seconds before."""
    return inc.recent_use(table(spark, root, "events").select("event_id", "user_id", "ts"), "user_id", "ts").select("event_id", "user_id", "recent")


@query("SELECT workspace_id, symbol_fqdn AS fqdn, max(description) AS description FROM raw_documents WHERE symbol_fqdn IS NOT NULL AND description IS NOT NULL GROUP BY ALL")
def o131_documents(spark: SparkSession, root: str) -> DataFrame:
    """One document per symbol, the greatest text of several."""
    return table(spark, root, "raw_documents").where("symbol_fqdn is not null and description is not null").groupBy("workspace_id", F.col("symbol_fqdn").alias("fqdn")).agg(F.max("description").alias("description"))


_DEAD = "dead AS (SELECT DISTINCT workspace_id, fqdn FROM symbols WHERE (workspace_id, fqdn) NOT IN (SELECT (workspace_id, fqdn) FROM live))"


@query(f"WITH {LIVE}, {EDGE}, {_DEAD} SELECT edge_id FROM e1 WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.workspace_id = e1.workspace_id AND d.fqdn = e1.from_fqdn)")
def o135_edges_after_delete(spark: SparkSession, root: str) -> DataFrame:
    """Edges that are left when removed symbols take their outbound edges along."""
    live = live_symbols(spark, root, "kind").select("workspace_id", "fqdn")
    dead = table(spark, root, "symbols").select("workspace_id", "fqdn").distinct().join(live, ["workspace_id", "fqdn"], "left_anti").withColumnRenamed("fqdn", "from_fqdn")
    return inc.delete_by(distinct_edges(spark, root, "workspace_id", "from_fqdn"), dead, ["workspace_id", "from_fqdn"]).select("edge_id")


@query(f"WITH {CUR}, {EDGE}, s AS (SELECT edge_id, unnest(sites) AS s FROM e1) SELECT s.file AS file, count(*) AS sites FROM s WHERE s.file NOT IN (SELECT path FROM cur WHERE coalesce(last_scan_error, '') <> '') GROUP BY 1")
def o136_sites_after_delete(spark: SparkSession, root: str) -> DataFrame:
    """Edge sites per file when those of files with a recorded error are deleted."""
    gone = current_files(spark, root, "last_scan_error").where("coalesce(last_scan_error, '') <> ''").select(F.col("path").alias("file"))
    s = distinct_edges(spark, root, "sites").select("edge_id", F.inline("sites"))
    return inc.delete_by(s.where("file is not null"), gone, ["file"]).groupBy("file").agg(F.count("*").alias("sites"))


@query(f"WITH {CALL}, n AS (SELECT * FROM c1 WHERE recorded_ms > 1767225600000), o AS (SELECT * FROM c1 WHERE recorded_ms <= 1767225600000 AND file_path NOT IN (SELECT file_path FROM n)) SELECT file_path, count(*) AS sites FROM (SELECT * FROM n UNION ALL SELECT * FROM o) GROUP BY 1")
def o137_replace_call_sites(spark: SparkSession, root: str) -> DataFrame:
    """Call sites rewritten per file: files seen after a point in time lose their older sites."""
    c = distinct_calls(spark, root, "file_path", "recorded_ms")
    new, old = c.where(F.col("recorded_ms") > LOOK_BACK_MS), c.where(F.col("recorded_ms") <= LOOK_BACK_MS)
    return inc.replace_by(old, new, ["file_path"]).groupBy("file_path").agg(F.count("*").alias("sites"))


@query(f"WITH {LIVE}, {CUR}, {EDGE}, k AS (SELECT workspace_id, fqdn FROM live WHERE file_path NOT IN (SELECT path FROM cur WHERE coalesce(last_scan_error, '') <> '')) SELECT e.edge_id, k2.fqdn AS to_fqdn, CASE WHEN k2.fqdn IS NULL THEN coalesce(e.to_fqdn, e.to_unresolved) END AS to_unresolved FROM e1 e JOIN k k1 ON k1.workspace_id = e.workspace_id AND k1.fqdn = e.from_fqdn LEFT JOIN k k2 ON k2.workspace_id = e.workspace_id AND k2.fqdn = coalesce(e.to_fqdn, e.to_unresolved)")
def o139_delete_files(spark: SparkSession, root: str) -> DataFrame:
    """Files deleted with their symbols and outbound edges; what pointed at them becomes text again."""
    gone = current_files(spark, root, "last_scan_error").where("coalesce(last_scan_error, '') <> ''").select(F.col("path").alias("file_path"))
    kept = inc.delete_by(live_symbols(spark, root, "file_path").select("workspace_id", "fqdn", "file_path"), gone, ["file_path"]).select("workspace_id", "fqdn")
    e = distinct_edges(spark, root, "workspace_id", "from_fqdn", "to_fqdn", "to_unresolved").join(kept.withColumnRenamed("fqdn", "from_fqdn"), ["workspace_id", "from_fqdn"], "left_semi")
    e = e.select("edge_id", "workspace_id", F.coalesce("to_fqdn", "to_unresolved").alias("text"))
    return e.join(kept.select("workspace_id", F.col("fqdn").alias("text"), F.col("fqdn").alias("to_fqdn")), ["workspace_id", "text"], "left").select("edge_id", "to_fqdn", F.when(F.col("to_fqdn").isNull(), F.col("text")).alias("to_unresolved"))


@query(f"WITH {EDGE}, i AS (SELECT workspace_id, from_fqdn AS module_fqdn, coalesce(to_fqdn, to_unresolved) AS origin, edge_id FROM e1 WHERE kind = 'IMPORTS') SELECT workspace_id, module_fqdn, string_split(origin, '::')[-1] AS local_name, origin AS origin_module, min(edge_id) AS edge_id FROM i GROUP BY ALL")
def o141_import_table(spark: SparkSession, root: str) -> DataFrame:
    """Imports per module, the first write of a (local name, origin) wins."""
    i = distinct_edges(spark, root, "workspace_id", "from_fqdn", "kind", "to_fqdn", "to_unresolved").where("kind = 'IMPORTS'")
    origin = F.coalesce("to_fqdn", "to_unresolved")
    rows = i.select("workspace_id", F.col("from_fqdn").alias("module_fqdn"), F.element_at(F.split(origin, "::"), -1).alias("local_name"), origin.alias("origin_module"), "edge_id")
    return inc.first_write_wins(rows, ["workspace_id", "module_fqdn", "local_name", "origin_module"], ["edge_id"])


@query("SELECT workspace_id, root_path, link_direction, status, indexing_mode FROM workspace_catalog WHERE status = 'active'")
def o143_catalog(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "workspace_catalog").where("status = 'active'")


@query("WITH d AS (SELECT run_id, count(DISTINCT path) AS done FROM processed_files GROUP BY run_id), t AS (SELECT count(DISTINCT path) AS total FROM files) SELECT r.run_id, r.status, coalesce(d.done, 0) AS done, t.total FROM scan_runs r LEFT JOIN d USING (run_id), t")
def o145_progress(spark: SparkSession, root: str) -> DataFrame:
    """Paths handled per run beside all there are."""
    d = table(spark, root, "processed_files").groupBy("run_id").agg(F.countDistinct("path").alias("done"))
    t = table(spark, root, "files").agg(F.countDistinct("path").alias("total"))
    return table(spark, root, "scan_runs").join(d, "run_id", "left").crossJoin(F.broadcast(t)).select("run_id", "status", F.coalesce("done", F.lit(0)).alias("done"), "total")


@query(f"WITH {LIVE} SELECT l.workspace_id, l.fqdn FROM live l WHERE NOT {_A.replace('path', 'l.file_path')}")
def o149_purge_ignored(spark: SparkSession, root: str) -> DataFrame:
    """Symbols that stay when indexed paths that match the ignore rules are purged."""
    s = live_symbols(spark, root, "file_path").where("file_path is not null")
    return s.where(~inc.ignored(F.col("file_path"), BEFORE)).select("workspace_id", "fqdn")


@query(f"WITH {EDGE}, s AS (SELECT edge_id, unnest(sites) AS s FROM e1) SELECT edge_id, CASE WHEN starts_with(s.file, 'ws:') THEN s.file ELSE 'ws:peer-1:' || s.file END AS file, s.line AS line, s.col AS col FROM s")
def o150_peer_paths(spark: SparkSession, root: str) -> DataFrame:
    """The sites of all edges as a peer would see them; paths that are marked already stay."""
    e = distinct_edges(spark, root, "workspace_id", "sites")
    return workspace.import_peer(e, "peer-1").select("edge_id", F.inline("sites"))
