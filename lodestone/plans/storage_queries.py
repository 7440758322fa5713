"""Driver queries: storage verbs, built-ins, envelopes (operators O-13, O-75, O-99, O-116, O-125, O-129 to O-134, O-140 to O-147)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators import builtins, graph, lookup, resolve, storage
from lodestone.plans.lookup_queries import _TERMS
from lodestone.plans.maintenance_queries import _B, AFTER, LOOK_BACK_MS
from lodestone.plans.registry import CUR, EDGE, GRAPH, LIVE, Registry
from lodestone.session import stored
from lodestone.sources.tables import current_files, distinct_calls, distinct_edges, graph_edges, live_symbols, table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


# -- answers -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LIVE}, r AS (SELECT DISTINCT callee_text AS query FROM call_sites WHERE id % 50 = 0 AND callee_text IS NOT NULL), h AS (SELECT r.query, l.fqdn FROM r JOIN live l ON l.name = r.query AND l.workspace_id = 'primary'),
n AS (SELECT r.query, count(h.fqdn) AS hits, list(h.fqdn ORDER BY h.fqdn) FILTER (h.fqdn IS NOT NULL) AS names FROM r LEFT JOIN h USING (query) GROUP BY r.query)
SELECT query, hits, CASE WHEN hits > 15 THEN 'lean' WHEN hits > 0 THEN 'full' ELSE 'empty' END AS mode, to_json({{'query': query, 'count': hits, 'results': coalesce(names[1:20], [])}}) AS body FROM n""")
def o13_search_envelopes(spark: SparkSession, root: str) -> DataFrame:
    """The JSON answer to each name lookup, with its count, its first 20 results and how it is shown."""
    r = table(spark, root, "call_sites").where("id % 50 = 0 and callee_text is not null").select(F.col("callee_text").alias("query")).distinct()
    s = live_symbols(spark, root, "name").where("workspace_id = 'primary'").select(F.col("name").alias("query"), "fqdn")
    return lookup.envelopes(r, s)


@query("""SELECT workspace_id, fqdn, symbol_id, last_modified_revision AS revision, CAST(coalesce(len(signature.params), 0) AS INT) AS params, signature.params[1].name AS first_param, signature."returns" AS returns, coalesce(signature.is_async, false) AS is_async, array_to_string(flags, ',') AS flags
FROM symbols WHERE signature IS NOT NULL GROUP BY ALL""")
def o99_json_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Signatures and flags as JSON text and back again."""
    s = table(spark, root, "symbols").where("signature is not null").select("workspace_id", "fqdn", "symbol_id", "last_modified_revision", "signature", "flags")
    types = {c: s.schema[c].dataType.simpleString() for c in ("signature", "flags")}
    back = s.select("workspace_id", "fqdn", "symbol_id", F.col("last_modified_revision").alias("revision"), *[expr.from_json_text(expr.to_json_text(F.col(c)), t).alias(c) for c, t in types.items()])
    p = F.col("signature.params")
    return back.select("workspace_id", "fqdn", "symbol_id", "revision", F.when(p.isNull(), 0).otherwise(F.size(p)).alias("params"), F.get(p, F.lit(0))["name"].alias("first_param"), F.col("signature.returns").alias("returns"), F.coalesce("signature.is_async", F.lit(False)).alias("is_async"), F.array_join("flags", ",").alias("flags")).distinct()


@query(f"""WITH {GRAPH}, q AS (SELECT DISTINCT fqdn AS focal FROM live WHERE symbol_id % 50 = 0 UNION SELECT DISTINCT to_unresolved FROM e1 WHERE edge_id % 50 = 0 AND to_unresolved IS NOT NULL),
b AS (SELECT from_fqdn AS a, target AS b FROM g WHERE resolved AND from_fqdn IS NOT NULL UNION SELECT target, from_fqdn FROM g WHERE resolved AND from_fqdn IS NOT NULL), k AS (SELECT q.focal, EXISTS (SELECT 1 FROM live l WHERE l.fqdn = q.focal) AS known FROM q)
SELECT k.focal, known, CASE WHEN known THEN least(500, 1 + count(DISTINCT CASE WHEN b.b <> k.focal THEN b.b END)) ELSE 0 END AS nodes FROM k LEFT JOIN b ON b.a = k.focal GROUP BY k.focal, known""")
def o75_focal_dispatch(spark: SparkSession, root: str) -> DataFrame:
    """Neighbourhoods one hop wide; a focal name that is no symbol comes back with none."""
    s = live_symbols(spark, root, "symbol_id")
    asked = s.where("symbol_id % 50 = 0").select(F.col("fqdn").alias("focal")).unionByName(distinct_edges(spark, root, "to_unresolved").where("edge_id % 50 = 0 and to_unresolved is not null").select(F.col("to_unresolved").alias("focal"))).distinct()
    return graph.dispatch(asked, graph_edges(spark, root), s, depth=1)


# -- files, projects, workspaces ---------------------------------------------------------------------------------------


@query(f"WITH {CUR} SELECT path, CASE WHEN path IN (SELECT path FROM processed_files WHERE run_id % 10 = 0) THEN 'delete' WHEN {_B} THEN 'ignore' WHEN content_hash IS NULL THEN 'rescan' ELSE 'keep' END AS action FROM cur WHERE path IS NOT NULL")
def o130_delete_plan(spark: SparkSession, root: str) -> DataFrame:
    """What happens to each path when a list is deleted and the ignore rules are the later ones."""
    listed = table(spark, root, "processed_files").where("run_id % 10 = 0").select("path")
    return storage.delete_plan(current_files(spark, root, "content_hash").where("path is not null"), AFTER, listed)


@query(f"WITH {CUR} SELECT path, CASE WHEN project_id NOT IN (SELECT project_id FROM projects WHERE kind IN ('node', 'lua')) THEN project_id END AS project_id FROM cur")
def o142_project_delete(spark: SparkSession, root: str) -> DataFrame:
    """Files after the node and lua projects are deleted: they stay and lose the reference."""
    return storage.delete_projects(table(spark, root, "projects"), current_files(spark, root, "project_id").select("path", "project_id"), F.col("kind").isin("node", "lua"))[1]


_NEW_ROOT = "(SELECT min(root_path) FROM projects)"


@query(f"""SELECT project_id, CASE WHEN root_path = {_NEW_ROOT} THEN 'renamed' ELSE label END AS label, root_path FROM projects UNION ALL SELECT (SELECT max(project_id) FROM projects) + 1, 'fresh', '/checkouts/new/one'""")
def o142_project_upsert(spark: SparkSession, root: str) -> DataFrame:
    """Projects after one known root (relabelled) and one new one were written."""
    p = table(spark, root, "projects").select("project_id", "label", "root_path")
    first = p.agg(F.min("root_path").alias("root_path")).select(F.lit(None).cast("int").alias("project_id"), F.lit("renamed").alias("label"), "root_path")
    fresh = spark.createDataFrame([(None, "fresh", "/checkouts/new/one")], p.schema)
    return storage.upsert_projects(p, first.unionByName(fresh))


@query("""SELECT workspace_id, root_path, CASE WHEN workspace_id <> 'primary' AND link_direction = 0 THEN 2 ELSE link_direction END AS link_direction, CASE WHEN status = 'paused' THEN 'active' ELSE status END AS status, indexing_mode FROM workspace_catalog
UNION ALL SELECT 'fresh', '/checkouts/primary', 1, 'active', 'extract'""")
def o143_catalog_changes(spark: SparkSession, root: str) -> DataFrame:
    """The catalog after a registration, new directions and the end of a pause; a direction that is none changes nothing."""
    c = table(spark, root, "workspace_catalog").select("workspace_id", "root_path", "link_direction", "status", "indexing_mode")
    fresh = spark.createDataFrame([("fresh", "/checkouts/primary", 1, "active", "extract"), ("primary", "/elsewhere", 0, "lost", "lost")], c.schema)
    direction = c.select("workspace_id", F.when((F.col("workspace_id") != "primary") & (F.col("link_direction") == 0), 2).otherwise(9).cast("int").alias("link_direction"), F.when(F.col("status") == "paused", "active").alias("status"))
    return storage.set_fields(storage.register(c, fresh), direction)


_PEER = "(SELECT min(workspace_id) FROM workspace_catalog WHERE workspace_id <> 'primary')"


@query(f"SELECT 'catalog' AS table_name, workspace_id, count(*) AS n FROM workspace_catalog WHERE workspace_id <> {_PEER} GROUP BY workspace_id UNION ALL SELECT 'symbols', workspace_id, count(*) FROM symbols WHERE workspace_id <> {_PEER} GROUP BY workspace_id UNION ALL SELECT 'edges', workspace_id, count(*) FROM edges WHERE workspace_id <> {_PEER} GROUP BY workspace_id")
def o129_unlink(spark: SparkSession, root: str) -> DataFrame:
    """Rows per table and workspace after a peer is unlinked; asking to unlink the primary one does nothing."""
    c = table(spark, root, "workspace_catalog")
    gone = c.where("workspace_id <> 'primary'").agg(F.min("workspace_id").alias("workspace_id")).unionByName(spark.createDataFrame([("primary",)], "workspace_id string"))
    left = storage.unlink({"catalog": c.select("workspace_id"), "symbols": table(spark, root, "symbols").select("workspace_id"), "edges": table(spark, root, "edges").select("workspace_id")}, gone)
    out = None
    for name, d in left.items():
        n = d.groupBy("workspace_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "workspace_id", "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"WITH {LIVE} SELECT c.workspace_id, coalesce(max(l.last_modified_revision), 0) AS revision, coalesce(max(l.last_modified_revision), 0) + 1 AS next_revision, 1 AS schema_version, CASE WHEN c.workspace_id = 'primary' THEN 'primary' ELSE 'linked' END AS kind FROM (SELECT DISTINCT workspace_id FROM workspace_catalog) c LEFT JOIN live l USING (workspace_id) GROUP BY c.workspace_id")
def o144_meta(spark: SparkSession, root: str) -> DataFrame:
    return storage.meta(live_symbols(spark, root, "last_modified_revision"), table(spark, root, "workspace_catalog"))


# -- rows about symbols ------------------------------------------------------------------------------------------------

_GRADE = "CASE confidence WHEN 'extracted' THEN 'high' WHEN 'inferred' THEN 'medium' ELSE confidence END"


@query(f"WITH {EDGE}, n AS (SELECT workspace_id, from_fqdn AS fqdn, edge_id, {_GRADE} AS confidence FROM e1 WHERE from_fqdn IS NOT NULL) SELECT workspace_id, fqdn, edge_id, confidence FROM n WHERE confidence IN ('low', 'medium', 'high') QUALIFY row_number() OVER (PARTITION BY workspace_id, fqdn ORDER BY edge_id DESC) = 1")
def o132_enrichments(spark: SparkSession, root: str) -> DataFrame:
    """The last enrichment of each symbol, taken from its edges; confidences that are none are refused."""
    c = F.when(F.col("confidence") == "extracted", "high").when(F.col("confidence") == "inferred", "medium").otherwise(F.col("confidence"))
    new = distinct_edges(spark, root, "workspace_id", "from_fqdn", "confidence").where("from_fqdn is not null").select("workspace_id", F.col("from_fqdn").alias("fqdn"), "edge_id", c.alias("confidence"))
    return storage.enrich(new.limit(0), new, order=("edge_id",))


_TWIN = "c AS (SELECT * FROM live WHERE kind = 'callable'), f AS (SELECT workspace_id, name, min(fqdn) AS fqdn FROM c WHERE suffix(file_path, '.c') GROUP BY ALL HAVING count(*) = 1)"


@query(f"WITH {LIVE}, {_TWIN} SELECT f.workspace_id, f.fqdn, min(c.file_path) AS decl_file FROM c JOIN f USING (workspace_id, name) WHERE suffix(c.file_path, '.h') AND NOT contains(c.file_path, '/query/') GROUP BY ALL")
def o133_declaration_store(spark: SparkSession, root: str) -> DataFrame:
    """Where each joined definition is declared, first file by name, after the declarations below ``query`` were deleted."""
    s = live_symbols(spark, root, "kind", "name", "file_path")
    twins = resolve.declaration_twins(s).where("outcome = 'joined'").select("workspace_id", F.col("decl_fqdn"), F.col("def_fqdn").alias("fqdn"))
    at = twins.join(s.select("workspace_id", F.col("fqdn").alias("decl_fqdn"), F.col("file_path").alias("decl_file")), ["workspace_id", "decl_fqdn"])
    left = storage.delete_by(at, at.where(F.contains("decl_file", F.lit("/query/"))).select("decl_file"), ["decl_file"])
    return left.groupBy("workspace_id", "fqdn").agg(F.min("decl_file").alias("decl_file"))


@query(f"""WITH o AS (SELECT * FROM symbols WHERE indexed_ms <= {LOOK_BACK_MS} QUALIFY row_number() OVER (PARTITION BY workspace_id, fqdn ORDER BY indexed_ms DESC, last_modified_revision DESC, symbol_id DESC) = 1),
n AS (SELECT * FROM symbols WHERE indexed_ms > {LOOK_BACK_MS} QUALIFY row_number() OVER (PARTITION BY workspace_id, fqdn ORDER BY indexed_ms DESC, last_modified_revision DESC, symbol_id DESC) = 1)
SELECT o.workspace_id, o.fqdn, coalesce(n.start_line, o.start_line) AS start_line, coalesce(n.end_line, o.end_line) AS end_line, coalesce(n.start_col, o.start_col) AS start_col, coalesce(n.end_col, o.end_col) AS end_col, o.last_modified_revision FROM o LEFT JOIN n ON n.workspace_id = o.workspace_id AND n.fqdn = o.fqdn""")
def o140_positions(spark: SparkSession, root: str) -> DataFrame:
    """Symbols as they were, with the positions of their later rows."""
    cols = ("start_line", "end_line", "start_col", "end_col", "last_modified_revision")

    def latest(cond: str) -> DataFrame:
        s = table(spark, root, "symbols").where(cond)
        return s.groupBy("workspace_id", "fqdn").agg(F.max_by(F.struct(*cols), F.struct("indexed_ms", "last_modified_revision", "symbol_id")).alias("r")).select("workspace_id", "fqdn", "r.*")

    return storage.move_positions(latest(f"indexed_ms <= {LOOK_BACK_MS}"), latest(f"indexed_ms > {LOOK_BACK_MS}"), ["workspace_id", "fqdn"])


@query(f"""WITH {LIVE}, d AS (SELECT {_TERMS.format("concat_ws(' ', name, fqdn)")} AS terms FROM live), t AS (SELECT unnest(list_distinct(terms)) AS term FROM d) SELECT term, count(*) AS documents, count(*) AS stored_documents, true AS sound FROM t GROUP BY term""")
def o146_index_rebuild(spark: SparkSession, root: str) -> DataFrame:
    """The inverted index, written anew and read back, beside the symbols it is made of."""
    s = live_symbols(spark, root, "name").select("workspace_id", "fqdn", "name")
    text = F.concat_ws(" ", "name", "fqdn")
    return storage.index_check(s, stored(lookup.postings(s, ["workspace_id", "fqdn"], text), "index"), text)


# -- built-ins ---------------------------------------------------------------------------------------------------------

_BUILTIN = "builtin(language, name, tier) AS (VALUES " + ", ".join(f"('{lang}', '{n}', '{tier}')" for lang, by in builtins.NAMES.items() for tier, names in by.items() for n in names.split()) + ")"


@query(f"""WITH {GRAPH}, {_BUILTIN}, lang AS (SELECT fqdn, min(language) AS language FROM live WHERE language IS NOT NULL GROUP BY fqdn),
o AS (SELECT g.edge_id, lang.language, regexp_extract(g.to_unresolved, '^([^.:]*)', 1) AS name FROM g JOIN lang ON lang.fqdn = g.from_fqdn WHERE NOT g.resolved AND g.to_unresolved IS NOT NULL)
SELECT o.language, coalesce(b.tier, 'none') AS tier, count(*) AS edges, count(DISTINCT o.name) AS names FROM o LEFT JOIN builtin b USING (language, name) GROUP BY ALL""")
def o116_builtin_tiers(spark: SparkSession, root: str) -> DataFrame:
    """Unresolved edges by language and by the tier of the name they begin with."""
    lang = live_symbols(spark, root, "language").where("language is not null").groupBy(F.col("fqdn").alias("from_fqdn")).agg(F.min("language").alias("language"))
    open_ = graph_edges(spark, root).where("not resolved and to_unresolved is not null").join(lang, "from_fqdn").select("edge_id", "language", F.regexp_extract("to_unresolved", "^([^.:]*)", 1).alias("name"))
    t = resolve.builtin_tier(open_, builtins.registry(spark))
    return t.groupBy("language", "tier").agg(F.count("*").alias("edges"), F.countDistinct("name").alias("names"))


_METHOD = "meth(parent_type, method, is_trait) AS (VALUES " + ", ".join(f"('{t}', '{m}', {trait})" for tab, trait in ((builtins.TRAIT_METHODS, "true"), (builtins.TYPE_METHODS, "false")) for t, ms in tab.items() for m in ms.split()) + ")"


@query(f"WITH {_BUILTIN}, {_METHOD} SELECT '<builtin>::' || language || '::' || name AS fqdn, name, '<builtin>/' || language AS file_path, false AS trait_method FROM builtin WHERE tier = 'edge' UNION ALL SELECT '<builtin>::rust::' || parent_type || '::' || method, method, '<builtin>/rust', is_trait FROM meth")
def o147_builtin_seeds(spark: SparkSession, root: str) -> DataFrame:
    """The symbols seeded for built-in names and methods."""
    s = builtins.seeds(builtins.registry(spark), builtins.methods(spark))
    return s.select("fqdn", "name", "file_path", F.array_contains("flags", "trait_method").alias("trait_method"))


_SEEDED = f"""{_METHOD}, open AS (SELECT edge_id, to_unresolved AS method, receiver_type FROM g WHERE NOT resolved AND to_unresolved IS NOT NULL AND kind = 'CALLS'),
byrecv AS (SELECT o.edge_id, '<builtin>::rust::' || m.parent_type || '::' || m.method AS hit FROM open o JOIN meth m ON o.receiver_type = m.parent_type AND o.method = m.method),
bytrait AS (SELECT o.edge_id, t.hit FROM open o JOIN (SELECT method, min('<builtin>::rust::' || parent_type || '::' || method) AS hit FROM meth WHERE is_trait GROUP BY method) t USING (method))"""
_TAILS = "tails AS (SELECT array_to_string(string_split(fqdn, '::')[-2:], '::') AS key, count(*) AS n FROM (SELECT DISTINCT fqdn FROM live) WHERE len(string_split(fqdn, '::')) >= 3 GROUP BY 1)"


def _with_seeds(spark: SparkSession, root: str) -> DataFrame:
    cols = ("workspace_id", "fqdn", "name", "flags")
    return live_symbols(spark, root, "name", "flags").select(*cols).unionByName(builtins.seeds(builtins.registry(spark), builtins.methods(spark)).select(*cols))


@query(f"WITH {GRAPH}, {_SEEDED}, {_TAILS} SELECT b.edge_id, b.hit, 'receiver_builtin' AS route FROM byrecv b JOIN open o USING (edge_id) WHERE NOT EXISTS (SELECT 1 FROM tails t WHERE t.n = 1 AND t.key = o.receiver_type || '::' || o.method) AND NOT EXISTS (SELECT 1 FROM live l WHERE l.fqdn = o.receiver_type || '::' || o.method)")
def o40_builtin_receivers(spark: SparkSession, root: str) -> DataFrame:
    """Calls on built-in types, resolved to the symbols seeded for their methods."""
    hits = resolve.by_receiver(resolve.open_calls(graph_edges(spark, root, "receiver_type")), _with_seeds(spark, root))
    return hits.where("route = 'receiver_builtin'")


@query(f"WITH {GRAPH}, {_SEEDED} SELECT edge_id, hit, 'builtin_trait' AS route FROM bytrait")
def o42_seeded_trait_methods(spark: SparkSession, root: str) -> DataFrame:
    """Calls of methods that a built-in trait has, resolved to the symbols seeded for them."""
    return resolve.by_builtin_trait(resolve.open_calls(graph_edges(spark, root, "receiver_type")), _with_seeds(spark, root))
