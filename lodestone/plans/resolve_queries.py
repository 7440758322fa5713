"""Driver queries: similarity, resolution, rollups (operators O-38 to O-49, O-52 to O-60, O-66, O-72, O-82 to O-86, O-93 to O-100)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.functions.text import jaro_winkler_udf
from lodestone.operators import resolve, rollup, similar
from lodestone.operators.lookup import first_per
from lodestone.plans.registry import CALL, CUR, EDGE, GRAPH, LIVE, Registry
from lodestone.session import ship
from lodestone.sources.tables import current_files, distinct_edges, graph_edges, live_symbols, table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


def _tok(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Za-z])([0-9])', '\\1_\\2', 'g'), '([0-9])([A-Za-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')".replace("{{", "{").replace("}}", "}")


@query(f"WITH {LIVE}, n AS (SELECT DISTINCT name FROM live WHERE name IS NOT NULL) SELECT name, array_to_string({_tok('name')}, ' ') AS tokens FROM n")
def o83_tokens(spark: SparkSession, root: str) -> DataFrame:
    n = live_symbols(spark, root, "name").where("name is not null").select("name").distinct()
    return n.select("name", F.array_join(expr.tokens(F.col("name")), " ").alias("tokens"))


_SCORE = "round(greatest(CASE WHEN len(a.t) = 0 AND len(b.t) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a.t), list_distinct(b.t))) * 1.0 / len(list_distinct(list_concat(a.t, b.t))) END, jaro_winkler_similarity(a.low, b.low)), 6)"


@query(f"""WITH {LIVE}, s AS (SELECT DISTINCT fqdn, name FROM live WHERE workspace_id = 'primary' AND name IS NOT NULL), n AS (SELECT name, lower(name) AS low, {_tok('name')} AS t FROM (SELECT DISTINCT name FROM s)),
q AS (SELECT * FROM n WHERE name IN (SELECT name FROM live WHERE symbol_id % 50 = 0)), p AS (SELECT a.name AS query, b.name, {_SCORE} AS score FROM q a JOIN n b ON a.low <> b.low)
SELECT query, fqdn, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, fqdn) AS INT) AS rank FROM p JOIN s USING (name) WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, fqdn) <= 20""")
def o86_similar_symbols(spark: SparkSession, root: str) -> DataFrame:
    """The 20 most similar symbols of the primary workspace for the name of every symbol whose id is divisible by 50."""
    live = live_symbols(spark, root, "name", "symbol_id")
    q = live.where("symbol_id % 50 = 0").select("name")
    s = live.where("workspace_id = 'primary' and name is not null").select("fqdn", "name").distinct()
    own = q.join(s.select("name").distinct(), "name", "left_semi")
    return similar.similar_symbols(own, s)


@query(f"""WITH {LIVE}, d AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM files WHERE contains(path, '/') AND NOT starts_with(path, 'ws:')), p AS (SELECT DISTINCT regexp_replace(dir, '/[^/]*$', '') AS parent, regexp_extract(dir, '([^/]*)$', 1) AS leaf FROM d WHERE contains(dir, '/')),
x AS (SELECT a.parent, a.leaf, b.leaf AS sibling, round(jaro_winkler_similarity(a.leaf, b.leaf), 6) AS score FROM p a JOIN p b ON a.parent = b.parent AND a.leaf <> b.leaf)
SELECT parent, leaf, sibling, score FROM x WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY parent, leaf ORDER BY score DESC, sibling) <= 5""")
def o85_sibling_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders whose name is like that of a folder beside them (a hint for mistyped paths)."""
    ship(spark)
    d = table(spark, root, "files").where("path like '%/%' and path not like 'ws:%'").select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct().where("dir like '%/%'")
    p = d.select(F.regexp_replace("dir", "/[^/]*$", "").alias("parent"), F.regexp_extract("dir", "([^/]*)$", 1).alias("leaf")).distinct()
    j = p.join(p.withColumnRenamed("leaf", "sibling"), "parent").where("leaf <> sibling").withColumn("score", F.round(jaro_winkler_udf("leaf", "sibling"), 6)).where("score >= 0.7")
    return first_per(j, ["parent", "leaf"], [F.desc("score"), "sibling"], 5).drop("rank")


@query(f"""WITH {LIVE}, c AS (SELECT * FROM live WHERE kind = 'callable'), f AS (SELECT workspace_id, name, count(*) AS n, min(fqdn) AS def_fqdn FROM c WHERE suffix(file_path, '.c') GROUP BY ALL)
SELECT c.workspace_id, c.fqdn AS decl_fqdn, CASE WHEN n = 1 THEN def_fqdn END AS def_fqdn, CASE WHEN n = 1 THEN 'joined' WHEN n > 1 THEN 'ambiguous' ELSE 'orphan' END AS outcome FROM c LEFT JOIN f USING (workspace_id, name) WHERE suffix(c.file_path, '.h')""")
def o38_declaration_twins(spark: SparkSession, root: str) -> DataFrame:
    return resolve.declaration_twins(live_symbols(spark, root, "kind", "name", "file_path"))


_OPEN = f"{GRAPH}, o AS (SELECT edge_id, workspace_id, from_fqdn, kind, to_unresolved AS method, receiver_type FROM g WHERE NOT resolved AND to_unresolved IS NOT NULL)"
_RECV = f"""n AS (SELECT DISTINCT fqdn FROM live), tails AS (SELECT array_to_string(string_split(fqdn, '::')[-2:], '::') AS key, min(fqdn) AS tail FROM n WHERE NOT starts_with(fqdn, '<builtin>::') AND len(string_split(fqdn, '::')) >= 3 GROUP BY 1 HAVING count(*) = 1),
rc AS (SELECT edge_id, receiver_type || '::' || method AS key, NOT contains(receiver_type, '::') AS bare FROM o WHERE kind = 'CALLS' AND receiver_type IS NOT NULL AND length(method) > 0),
rv AS (SELECT rc.edge_id, coalesce(a.fqdn, CASE WHEN bare THEN t.tail END, b.fqdn) AS hit, CASE WHEN a.fqdn IS NOT NULL THEN 'receiver_exact' WHEN bare AND t.tail IS NOT NULL THEN 'receiver_suffix' WHEN b.fqdn IS NOT NULL THEN 'receiver_builtin' END AS route FROM rc LEFT JOIN n a ON a.fqdn = rc.key LEFT JOIN tails t ON t.key = rc.key LEFT JOIN n b ON b.fqdn = '<builtin>::rust::' || rc.key)"""
_TRAIT = """im AS (SELECT DISTINCT unnest(list_distinct([from_fqdn, string_split(from_fqdn, '::')[-1]])) AS receiver_type, target AS trait FROM g WHERE kind = 'IMPLEMENTS' AND target IS NOT NULL AND NOT starts_with(from_fqdn, '<builtin>::')),
td AS (SELECT o.edge_id, min_by(n.fqdn, im.trait) AS hit FROM o JOIN im USING (receiver_type) JOIN n ON n.fqdn = im.trait || '::' || o.method WHERE o.kind = 'CALLS' GROUP BY o.edge_id)"""
_CHAIN = """ex AS (SELECT workspace_id AS pw, module, name AS symbol, fqdn FROM live WHERE module IS NOT NULL AND coalesce(visibility, 'public') <> 'private'), sp AS (SELECT edge_id, workspace_id AS own, string_split(method, '::') AS s FROM o WHERE contains(method, '::')), sn AS (SELECT edge_id, own, s, unnest(range(1, len(s))) AS n FROM sp),
sk AS (SELECT edge_id, own, n, 0 AS alt, s[n + 1] AS symbol, array_to_string(s[n + 2:], '::') AS tail, array_to_string(s[1:n], '::') AS module FROM sn UNION ALL SELECT edge_id, own, n, 1, s[n + 1], array_to_string(s[n + 2:], '::'), array_to_string(list_concat([replace(s[1], '_', '-')], s[2:n]), '::') FROM sn WHERE contains(s[1], '_')),
ch AS (SELECT edge_id, CASE WHEN tail = '' THEN fqdn ELSE fqdn || '::' || tail END AS hit, pw AS provider FROM sk JOIN ex USING (module, symbol) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY n DESC, alt, pw <> own, pw, fqdn) = 1)"""


@query(f"WITH {_OPEN}, {_RECV} SELECT * FROM rv WHERE hit IS NOT NULL")
def o40_receiver_resolution(spark: SparkSession, root: str) -> DataFrame:
    return resolve.by_receiver(resolve.open_calls(graph_edges(spark, root, "receiver_type")), live_symbols(spark, root, "name"))


@query(f"WITH {_OPEN}, {_RECV}, {_TRAIT} SELECT edge_id, hit, 'trait_dispatch' AS route FROM td")
def o41_trait_dispatch(spark: SparkSession, root: str) -> DataFrame:
    e = graph_edges(spark, root, "receiver_type")
    return resolve.by_trait(resolve.open_calls(e), live_symbols(spark, root, "name"), e)


@query(f"WITH {_OPEN}, t AS (SELECT name AS method, min(fqdn) AS hit FROM live WHERE starts_with(fqdn, '<builtin>::') AND list_contains(flags, 'trait_method') GROUP BY name) SELECT edge_id, hit, 'builtin_trait' AS route FROM o JOIN t USING (method) WHERE o.kind = 'CALLS'")
def o42_builtin_trait_methods(spark: SparkSession, root: str) -> DataFrame:
    return resolve.by_builtin_trait(resolve.open_calls(graph_edges(spark, root, "receiver_type")), live_symbols(spark, root, "name", "flags"))


@query(f"WITH {_OPEN}, {_CHAIN} SELECT edge_id, hit, 'suffix_chain' AS route, provider FROM ch")
def o43_suffix_chain(spark: SparkSession, root: str) -> DataFrame:
    return resolve.by_suffix_chain(resolve.open_calls(graph_edges(spark, root, "receiver_type")), resolve.exports(live_symbols(spark, root, "module", "name", "visibility")))


@query(f"WITH {LIVE} SELECT workspace_id, module, name AS symbol, fqdn FROM live WHERE module IS NOT NULL AND coalesce(visibility, 'public') <> 'private'")
def o44_root_exports(spark: SparkSession, root: str) -> DataFrame:
    return resolve.exports(live_symbols(spark, root, "module", "name", "visibility"))


@query(f"WITH {LIVE} SELECT name AS symbol, count(*) AS providers, count(DISTINCT workspace_id) AS workspaces, min(fqdn) AS first_provider FROM live WHERE module IS NOT NULL AND coalesce(visibility, 'public') <> 'private' GROUP BY name")
def o45_providers(spark: SparkSession, root: str) -> DataFrame:
    """All providers of each exported name over the linked workspaces."""
    return resolve.exports(live_symbols(spark, root, "module", "name", "visibility")).groupBy("symbol").agg(F.count("*").alias("providers"), F.countDistinct("workspace_id").alias("workspaces"), F.min("fqdn").alias("first_provider"))


@query(f"WITH {GRAPH} SELECT coalesce(CASE WHEN contains(target, '::') THEN regexp_replace(target, '::[^:]*$', '') END, target) AS origin_module, count(*) AS imports, count(DISTINCT from_fqdn) AS importers FROM g WHERE kind = 'IMPORTS' GROUP BY 1")
def o46_imports_by_origin(spark: SparkSession, root: str) -> DataFrame:
    """Reverse import index."""
    e = graph_edges(spark, root).where("kind = 'IMPORTS'")
    return e.groupBy(F.coalesce(F.when(F.contains("target", F.lit("::")), F.regexp_replace("target", "::[^:]*$", "")), F.col("target")).alias("origin_module")).agg(F.count("*").alias("imports"), F.countDistinct("from_fqdn").alias("importers"))


@query(f"WITH {LIVE} SELECT workspace_id, fqdn, file_path FROM live WHERE NOT coalesce(is_external, false) AND file_path IS NOT NULL AND file_path NOT IN (SELECT path FROM files WHERE path IS NOT NULL)")
def o48_unseen_paths(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of files that a walk no longer sees; external ones are exempt."""
    s = live_symbols(spark, root, "is_external", "file_path").where("not coalesce(is_external, false) and file_path is not null").select("workspace_id", "fqdn", "file_path")
    return s.join(table(spark, root, "files").select(F.col("path").alias("file_path")), "file_path", "left_anti")


@query(f"WITH {LIVE}, {EDGE} SELECT e.edge_id, l.fqdn AS to_fqdn, CASE WHEN l.fqdn IS NULL THEN coalesce(e.to_fqdn, e.to_unresolved) END AS to_unresolved FROM e1 e LEFT JOIN live l ON l.workspace_id = e.workspace_id AND l.fqdn = coalesce(e.to_fqdn, e.to_unresolved)")
def o49_promote_demote(spark: SparkSession, root: str) -> DataFrame:
    """Targets worked out anew by (workspace, name): text that names a live symbol is promoted, dead targets are demoted."""
    e = distinct_edges(spark, root, "workspace_id", "to_fqdn", "to_unresolved").select("edge_id", "workspace_id", F.coalesce("to_fqdn", "to_unresolved").alias("text"))
    s = live_symbols(spark, root, "kind").select("workspace_id", F.col("fqdn").alias("text"), F.col("fqdn").alias("to_fqdn"))
    return e.join(s, ["workspace_id", "text"], "left").select("edge_id", "to_fqdn", F.when(F.col("to_fqdn").isNull(), F.col("text")).alias("to_unresolved"))


@query(f"""WITH {_OPEN}, {_RECV}, {_TRAIT}, {_CHAIN}, bt AS (SELECT name AS method, min(fqdn) AS hit FROM live WHERE starts_with(fqdn, '<builtin>::') AND list_contains(flags, 'trait_method') GROUP BY name),
r AS (SELECT o.edge_id, CASE WHEN EXISTS (SELECT 1 FROM live l WHERE l.workspace_id = o.workspace_id AND l.fqdn = o.method) THEN 'exact_text' WHEN rv.hit IS NOT NULL THEN rv.route WHEN td.hit IS NOT NULL THEN 'trait_dispatch' WHEN o.kind = 'CALLS' AND bt.hit IS NOT NULL THEN 'builtin_trait' WHEN ch.hit IS NOT NULL THEN 'suffix_chain' ELSE 'unresolved' END AS route
FROM o LEFT JOIN rv ON rv.edge_id = o.edge_id LEFT JOIN td ON td.edge_id = o.edge_id LEFT JOIN bt ON bt.method = o.method LEFT JOIN ch ON ch.edge_id = o.edge_id) SELECT route, count(*) AS edges FROM r GROUP BY route""")
def o56_resolve_report(spark: SparkSession, root: str) -> DataFrame:
    return resolve.report(live_symbols(spark, root, "module", "name", "visibility", "flags"), graph_edges(spark, root, "receiver_type"))


_HOME = f"{GRAPH}, {CUR}, cp AS (SELECT project_id, label, min(project_id) OVER (PARTITION BY label) AS cid FROM projects), home AS (SELECT DISTINCT l.fqdn, cp.cid FROM live l JOIN cur c ON c.path = l.file_path JOIN cp ON cp.project_id = c.project_id)"


@query(f"WITH {_HOME} SELECT a.cid AS from_project, b.cid AS to_project, g.kind, count(*) AS weight FROM g JOIN home a ON a.fqdn = g.from_fqdn JOIN home b ON b.fqdn = g.target WHERE g.resolved AND a.cid <> b.cid GROUP BY ALL")
def o52_project_edges(spark: SparkSession, root: str) -> DataFrame:
    homes = rollup.symbol_projects(live_symbols(spark, root, "file_path"), current_files(spark, root, "project_id"), table(spark, root, "projects"))
    return rollup.project_edges(graph_edges(spark, root), homes)


@query(f"""WITH {LIVE}, i AS (SELECT DISTINCT fqdn FROM live WHERE fqdn = 'graphite_core::core' OR starts_with(fqdn, 'graphite_core::core::')), m AS (SELECT DISTINCT fqdn AS module FROM live WHERE kind = 'module' AND len(string_split(fqdn, '::')) BETWEEN 2 AND 3),
h AS (SELECT i.fqdn, max_by(m.module, length(m.module)) AS module FROM i JOIN m ON i.fqdn = m.module OR starts_with(i.fqdn, m.module || '::') GROUP BY i.fqdn) SELECT module, CAST(len(string_split(module, '::')) - 2 AS INT) AS depth, count(*) AS symbols FROM h GROUP BY module""")
def o53_scoped_modules(spark: SparkSession, root: str) -> DataFrame:
    """Symbols below one module by their nearest module, one level deep."""
    return rollup.module_rollup(live_symbols(spark, root, "kind"), "graphite_core::core")[0].select("module", "depth", "symbols")


_UP = "regexp_replace({0}, '::[^:]*$', '')"


@query(f"""WITH {GRAPH}, ms AS (SELECT DISTINCT string_split(fqdn, '::') AS s FROM live WHERE kind = 'module'), mods AS (SELECT DISTINCT array_to_string(s[1:i], '::') AS m FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM ms)),
sy AS (SELECT DISTINCT fqdn, string_split(fqdn, '::') AS s FROM live), up AS (SELECT fqdn, i AS depth, array_to_string(s[1:i], '::') AS m FROM (SELECT fqdn, s, unnest(range(1, len(s) + 1)) AS i FROM sy) WHERE array_to_string(s[1:i], '::') IN (SELECT m FROM mods)),
home AS (SELECT a.fqdn, a.m AS scope, max_by(b.m, b.depth) AS module FROM up a JOIN up b ON a.fqdn = b.fqdn AND b.depth BETWEEN a.depth AND a.depth + 1 GROUP BY a.fqdn, a.m), nodes AS (SELECT DISTINCT scope, module FROM home),
ge AS (SELECT from_fqdn, target, kind, count(*) AS n FROM g WHERE resolved GROUP BY ALL)
SELECT n.scope, {_UP.format('n.module')} AS from_module, n.module AS to_module, 'parent_child' AS edge_kind, NULL AS kind, 1 AS weight FROM nodes n JOIN nodes p ON p.scope = n.scope AND p.module = {_UP.format('n.module')} WHERE n.module <> n.scope
UNION ALL SELECT a.scope, a.module, b.module, 'cross', kind, CAST(sum(n) AS BIGINT) FROM ge JOIN home a ON a.fqdn = from_fqdn JOIN home b ON b.fqdn = target AND b.scope = a.scope WHERE a.module <> b.module AND {_UP.format('a.module')} <> b.module AND {_UP.format('b.module')} <> a.module GROUP BY ALL""")
def o53_scoped_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges between the modules right below each module."""
    return rollup.scoped_edges(live_symbols(spark, root, "kind"), graph_edges(spark, root))


@query(f"WITH {LIVE} SELECT module, fqdn AS representative FROM live WHERE module IS NOT NULL QUALIFY row_number() OVER (PARTITION BY module ORDER BY entry_point IS NULL, NOT coalesce(visibility = 'public', false), len(string_split(fqdn, '::')), fqdn) = 1")
def o54_module_representative(spark: SparkSession, root: str) -> DataFrame:
    return rollup.representative(live_symbols(spark, root, "module", "entry_point", "visibility"))


@query(f"WITH {LIVE}, {CUR} SELECT DISTINCT c.project_id, l.module FROM live l JOIN cur c ON c.path = l.file_path WHERE l.module IS NOT NULL AND c.project_id IS NOT NULL")
def o55_modules_by_project(spark: SparkSession, root: str) -> DataFrame:
    f = current_files(spark, root, "project_id").where("project_id is not null").select(F.col("path").alias("file_path"), "project_id")
    return live_symbols(spark, root, "module", "file_path").where("module is not null").join(f, "file_path").select("project_id", "module").distinct()


@query(f"WITH {LIVE} SELECT (SELECT count(*) FROM live) AS symbols, (SELECT count(*) FROM live WHERE name IS NOT NULL OR fqdn IS NOT NULL) AS indexed")
def o57_index_integrity(spark: SparkSession, root: str) -> DataFrame:
    """Symbols against documents of the inverted index; both counts must agree."""
    from lodestone.operators.lookup import postings

    s = live_symbols(spark, root, "name")
    docs = postings(s.select("workspace_id", "fqdn", "name"), ["workspace_id", "fqdn"], F.concat_ws(" ", "name", "fqdn")).select("workspace_id", "fqdn").distinct()
    return s.agg(F.count("*").alias("symbols")).crossJoin(docs.agg(F.count("*").alias("indexed")))


@query(f"""WITH {LIVE}, {CUR}, p AS (SELECT c.project_id, min(string_split(l.file_path, '/')) AS a, max(string_split(l.file_path, '/')) AS b FROM live l JOIN cur c ON c.path = l.file_path WHERE c.project_id IS NOT NULL GROUP BY ALL),
k AS (SELECT project_id, a, b, list_filter(range(1, len(a) + 1), lambda i: a[1:i] = b[1:i]) AS ok FROM p) SELECT project_id, array_to_string(a[1:len(ok)], '/') AS prefix FROM k""")
def o59_common_path(spark: SparkSession, root: str) -> DataFrame:
    """Longest common path of each project's files with symbols."""
    f = current_files(spark, root, "project_id").where("project_id is not null").select(F.col("path").alias("file_path"), "project_id")
    return rollup.common_path(live_symbols(spark, root, "file_path").join(f, "file_path").select("project_id", "file_path"), "project_id", "file_path")


@query("SELECT project_id, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || rel_path || ')' ELSE label END AS shown FROM projects")
def o80_project_labels(spark: SparkSession, root: str) -> DataFrame:
    return rollup.labels(table(spark, root, "projects"))


@query(f"WITH {LIVE}, m AS (SELECT DISTINCT fqdn FROM live WHERE kind = 'module') SELECT fqdn, CAST(len(string_split(fqdn, '::')) AS INT) AS depth, row_number() OVER (ORDER BY len(string_split(fqdn, '::')), fqdn) - 1 AS id FROM m")
def o66_stable_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids in order of (depth, path). A global sort by range partitions, then an offset per partition: no single task
    numbers all modules."""
    m = live_symbols(spark, root, "kind").where("kind = 'module'").select("fqdn", F.size(expr.segments(F.col("fqdn"))).alias("depth")).distinct()
    from lodestone.operators.order import dense_ids

    return dense_ids(m, ["depth", "fqdn"]).select("fqdn", "depth", "id")


@query(f"WITH {LIVE} SELECT workspace_id, fqdn, regexp_replace(CASE WHEN coalesce(signature.is_async, false) THEN 'async ' ELSE '' END || name || '(' || array_to_string(list_transform(coalesce(signature.params, []), lambda p: p.name || coalesce(': ' || p.ty, '') || coalesce(' = ' || p.\"default\", '')), ', ') || ')' || coalesce(' -> ' || signature.\"returns\", ''), '\\s+', ' ', 'g') AS rendered FROM live WHERE signature IS NOT NULL")
def o93_signatures(spark: SparkSession, root: str) -> DataFrame:
    s = live_symbols(spark, root, "name", "signature").where("signature is not null")
    return s.select("workspace_id", "fqdn", expr.render_signature(F.col("name"), F.col("signature")).alias("rendered"))


@query(f"WITH {LIVE}, d AS (SELECT workspace_id, symbol_fqdn AS fqdn, max(description) AS doc FROM raw_documents WHERE trim(description, E' \\t\\n\\r') <> '' GROUP BY ALL) SELECT l.workspace_id, l.fqdn, '**' || l.name || '** ' || l.kind || coalesce(chr(10) || chr(10) || d.doc, '') AS hover FROM live l LEFT JOIN d USING (workspace_id, fqdn)")
def o94_hover(spark: SparkSession, root: str) -> DataFrame:
    """Markdown of a symbol: name and kind, then its documentation."""
    d = table(spark, root, "raw_documents").where("trim(BOTH ' \t\n\r' FROM description) <> ''").groupBy("workspace_id", F.col("symbol_fqdn").alias("fqdn")).agg(F.max("description").alias("doc"))
    j = live_symbols(spark, root, "name", "kind").join(d, ["workspace_id", "fqdn"], "left")
    return j.select("workspace_id", "fqdn", F.concat(F.lit("**"), "name", F.lit("** "), "kind", F.coalesce(F.concat(F.lit("\n\n"), "doc"), F.lit(""))).alias("hover"))


_MP = "list_filter(string_split(regexp_replace(regexp_replace(replace(path, '\\', '/'), '^(?:.*/)?src/', ''), '\\.[^./]+$', ''), '/'), lambda x: x <> '')"


@query(f"WITH p AS (SELECT DISTINCT path FROM files), s AS (SELECT path, {_MP} AS s FROM p) SELECT path, array_to_string(CASE WHEN s[-1] IN ('lib','main','mod','index','init') THEN s[1:len(s)-1] ELSE s END, '::') AS module FROM s")
def o95_module_of_path(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "files").select("path").distinct()
    return p.select("path", expr.module_path(F.col("path")).alias("module"))


@query(f"WITH {LIVE} SELECT DISTINCT fqdn, string_split(fqdn, '::')[-1] AS last, CASE WHEN contains(fqdn, '::') THEN array_to_string(string_split(fqdn, '::')[1:-2], '::') END AS parent FROM live")
def o96_segments(spark: SparkSession, root: str) -> DataFrame:
    s = live_symbols(spark, root, "kind").select("fqdn").distinct()
    return s.select("fqdn", expr.last_segment(F.col("fqdn")).alias("last"), expr.parent(F.col("fqdn")).alias("parent"))


@query("SELECT DISTINCT path, content_hash, sha256(content) AS digest FROM files WHERE content IS NOT NULL")
def o100_content_digest(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "files").where("content is not null").select("path", "content_hash", F.sha2("content", 256).alias("digest")).distinct()
