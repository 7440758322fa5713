"""Driver queries: neighbours, contexts, positions, traversal (operators O-29 to O-37, O-50, O-51, O-58, O-62 to O-68, O-71, O-73 to O-81)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators import graph, neighbors, position
from lodestone.operators.lookup import first_per
from lodestone.plans.lookup_queries import IS_TEST
from lodestone.plans.registry import CALL, CUR, EDGE, GRAPH, LIVE, Registry
from lodestone.sources.tables import current_files, distinct_calls, distinct_edges, graph_edges, live_symbols, table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

_OUT = "CASE kind WHEN 'CALLS' THEN 'callees' WHEN 'IMPORTS' THEN 'imports' ELSE 'depends_on' END"
_IN = "CASE kind WHEN 'CALLS' THEN 'callers' WHEN 'IMPORTS' THEN 'imported_by' ELSE 'dependents' END"
_NT = "(contains({0},'::tests::') OR contains({0},'::test::') OR suffix({0},'_test') OR suffix({0},'_tests') OR suffix({0},'.test') OR suffix({0},'.spec'))"
_GROUPS = f"""{GRAPH}, o AS (SELECT g.from_fqdn AS fqdn, {_OUT.replace('kind', 'g.kind')} AS bucket, g.target AS neighbour, g.edge_id FROM g JOIN live l ON l.workspace_id = g.workspace_id AND l.fqdn = g.from_fqdn),
i AS (SELECT target AS fqdn, {_IN} AS bucket, from_fqdn AS neighbour, edge_id FROM g WHERE target IN (SELECT fqdn FROM live)),
t AS (SELECT fqdn, 'tests' AS bucket, neighbour, edge_id FROM i WHERE bucket IN ('callers','dependents') AND {_NT.format('neighbour')}), grp AS (SELECT * FROM o UNION ALL SELECT * FROM i UNION ALL SELECT * FROM t)"""


@query(f"WITH {GRAPH} SELECT g.workspace_id, g.from_fqdn AS fqdn, g.edge_id, g.kind, g.target AS neighbour, g.resolved FROM g JOIN live l ON l.workspace_id = g.workspace_id AND l.fqdn = g.from_fqdn")
def o29_edges_from(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.outbound(live_symbols(spark, root, "kind"), graph_edges(spark, root)).drop("bucket")


@query(f"WITH {GRAPH} SELECT workspace_id, target AS fqdn, edge_id, kind, from_fqdn AS neighbour FROM g WHERE target IN (SELECT fqdn FROM live)")
def o30_edges_to(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.inbound(live_symbols(spark, root, "kind"), graph_edges(spark, root)).drop("bucket", "resolved")


@query(f"WITH {LIVE}, d AS (SELECT workspace_id, symbol_fqdn AS fqdn, max(description) AS description, count(DISTINCT description) AS texts FROM raw_documents WHERE description IS NOT NULL GROUP BY ALL) SELECT l.workspace_id, l.fqdn, l.kind, d.description, coalesce(d.texts, 0) AS texts FROM live l LEFT JOIN d USING (workspace_id, fqdn)")
def o32_context(spark: SparkSession, root: str) -> DataFrame:
    """Each symbol with its documentation, if any (the greatest of several texts)."""
    d = table(spark, root, "raw_documents").where("description is not null").groupBy("workspace_id", F.col("symbol_fqdn").alias("fqdn")).agg(F.max("description").alias("description"), F.countDistinct("description").alias("texts"))
    return live_symbols(spark, root, "kind").select("workspace_id", "fqdn", "kind").join(d, ["workspace_id", "fqdn"], "left").withColumn("texts", F.coalesce("texts", F.lit(0)))


@query(f"WITH {_GROUPS} SELECT l.fqdn, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS {b}" for b in neighbors.COUNTED) + " FROM (SELECT DISTINCT fqdn FROM live) l LEFT JOIN grp USING (fqdn) GROUP BY l.fqdn")
def o50_context_summary(spark: SparkSession, root: str) -> DataFrame:
    """Callers, callees, imports, importers, dependents and tests of every symbol, counted."""
    return neighbors.summary(live_symbols(spark, root, "kind"), graph_edges(spark, root))


@query(f"WITH {_GROUPS} SELECT fqdn, bucket, neighbour, edge_id FROM grp")
def o51_context_groups(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.grouped(live_symbols(spark, root, "kind"), graph_edges(spark, root))


@query(f"WITH {_GROUPS} SELECT l.kind AS kind, bucket, count(*) AS pairs FROM (SELECT DISTINCT fqdn, bucket, neighbour FROM grp) x JOIN (SELECT DISTINCT fqdn, kind FROM live) l USING (fqdn) GROUP BY ALL")
def o58_relation_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Distinct neighbours per family of symbol and relation."""
    g = neighbors.grouped(live_symbols(spark, root, "kind"), graph_edges(spark, root)).select("fqdn", "bucket", "neighbour").distinct()
    s = live_symbols(spark, root, "kind").select("fqdn", expr.family(F.col("kind")).alias("kind")).distinct()
    return g.join(s, "fqdn").groupBy("kind", "bucket").agg(F.count("*").alias("pairs"))


@query(f"""WITH {GRAPH}, {CALL}, r AS (SELECT DISTINCT fqdn, trim(name) AS name FROM live WHERE kind = 'callable' AND symbol_id % 50 = 0 AND length(trim(name)) > 0),
h AS (SELECT r.fqdn, c.from_fqdn, c.id, row_number() OVER (PARTITION BY r.fqdn ORDER BY c.id) AS n FROM r JOIN c1 c ON contains(c.callee_text, r.name)),
k AS (SELECT DISTINCT target AS fqdn, from_fqdn FROM g WHERE kind = 'CALLS' AND resolved),
o AS (SELECT h.fqdn, h.from_fqdn, min(h.id) AS id FROM h WHERE n <= 200 AND h.from_fqdn <> h.fqdn AND NOT EXISTS (SELECT 1 FROM k WHERE k.fqdn = h.fqdn AND k.from_fqdn = h.from_fqdn) GROUP BY ALL)
SELECT fqdn, from_fqdn, id FROM o QUALIFY row_number() OVER (PARTITION BY fqdn ORDER BY id) <= 25""")
def o62_textual_callers(spark: SparkSession, root: str) -> DataFrame:
    """Callers by text of every callable whose id is divisible by 50 (the query set of a search), against all call sites."""
    r = live_symbols(spark, root, "kind", "symbol_id", "name").where("kind = 'callable' and symbol_id % 50 = 0").select("fqdn", "name").distinct()
    known = graph_edges(spark, root).where("kind = 'CALLS' and resolved").select(F.col("target").alias("fqdn"), "from_fqdn")
    return neighbors.textual_callers(r, distinct_calls(spark, root, "callee_text", "from_fqdn"), known)


@query(f"WITH {_GROUPS}, d AS (SELECT DISTINCT fqdn, bucket, neighbour FROM grp) SELECT fqdn, bucket, neighbour, CAST(rank AS INT) AS rank, greatest(n - 5, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY fqdn, bucket ORDER BY neighbour) AS rank, count(*) OVER (PARTITION BY fqdn, bucket) AS n FROM d) WHERE rank <= 5")
def o65_bucket_top5(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.top_of_bucket(neighbors.grouped(live_symbols(spark, root, "kind"), graph_edges(spark, root)))


@query(f"WITH {EDGE}, s AS (SELECT edge_id, unnest(sites) AS s FROM e1) SELECT edge_id, CAST(row_number() OVER (PARTITION BY edge_id ORDER BY s.file, s.line, s.col) - 1 AS INT) AS ordinal, s.file AS file, s.line AS line, s.col AS col FROM s")
def o67_ordered_sites(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.ordered_sites(distinct_edges(spark, root, "sites"))


@query(f"WITH {_GROUPS} SELECT fqdn, neighbour, edge_id FROM grp WHERE bucket = 'tests'")
def o68_tests(spark: SparkSession, root: str) -> DataFrame:
    """Callers and dependents that look like tests, as a bag."""
    return neighbors.grouped(live_symbols(spark, root, "kind"), graph_edges(spark, root)).where("bucket = 'tests'").select("fqdn", "neighbour", "edge_id")


@query(f"WITH {_GROUPS} SELECT x.fqdn, x.bucket, x.neighbour, x.edge_id, l.kind AS neighbour_kind, l.visibility AS neighbour_visibility FROM grp x LEFT JOIN live l ON l.fqdn = x.neighbour AND l.workspace_id = 'primary'")
def o77_context_depth2(spark: SparkSession, root: str) -> DataFrame:
    """Context whose neighbours carry their own row where they are symbols of the primary workspace."""
    g = neighbors.grouped(live_symbols(spark, root, "kind"), graph_edges(spark, root))
    s = live_symbols(spark, root, "kind", "visibility").where("workspace_id = 'primary'").select(F.col("fqdn").alias("neighbour"), F.col("kind").alias("neighbour_kind"), F.col("visibility").alias("neighbour_visibility"))
    return g.join(s, "neighbour", "left").select("fqdn", "bucket", "neighbour", "edge_id", "neighbour_kind", "neighbour_visibility")


@query(f"""WITH {LIVE}, {CALL}, h AS (SELECT c.id AS probe_id, l.fqdn, row_number() OVER (PARTITION BY c.id ORDER BY (l.end_line - l.start_line) * 1000 + (l.end_col - l.start_col), l.fqdn) AS rn FROM c1 c JOIN live l ON l.file_path = c.file_path
AND l.start_line <= c.line AND l.end_line >= c.line AND (l.start_line < c.line OR l.start_col <= c.col) AND (l.end_line > c.line OR l.end_col >= c.col)) SELECT c.id AS probe_id, c.file_path, c.line, c.col, h.fqdn FROM c1 c LEFT JOIN h ON h.probe_id = c.id AND h.rn = 1""")
def o34_symbol_at_position(spark: SparkSession, root: str) -> DataFrame:
    """Smallest symbol around every call site."""
    p = distinct_calls(spark, root, "file_path", "line", "col").withColumnRenamed("id", "probe_id")
    return position.symbol_at(p, live_symbols(spark, root, "file_path", "start_line", "end_line", "start_col", "end_col")).select("probe_id", "file_path", "line", "col", "fqdn")


@query(f"""WITH {LIVE}, h AS (SELECT a.workspace_id, a.fqdn, b.fqdn AS container, row_number() OVER (PARTITION BY a.workspace_id, a.fqdn ORDER BY (b.end_line - b.start_line) * 1000 + (b.end_col - b.start_col), b.fqdn) AS rn FROM live a JOIN live b ON a.file_path = b.file_path
AND b.start_line <= a.start_line AND b.end_line >= a.start_line AND (b.start_line < a.start_line OR b.start_col <= a.start_col) AND (b.end_line > a.start_line OR b.end_col >= a.start_col)
AND b.start_line <= a.end_line AND b.end_line >= a.end_line AND (b.start_line < a.end_line OR b.start_col <= a.end_col) AND (b.end_line > a.end_line OR b.end_col >= a.end_col)
AND (b.end_line - b.start_line) * 1000 + (b.end_col - b.start_col) > (a.end_line - a.start_line) * 1000 + (a.end_col - a.start_col))
SELECT l.workspace_id, l.fqdn, l.file_path, h.container FROM live l LEFT JOIN h ON h.workspace_id = l.workspace_id AND h.fqdn = l.fqdn AND h.rn = 1 WHERE l.start_line IS NOT NULL AND l.end_line IS NOT NULL""")
def o37_outline(spark: SparkSession, root: str) -> DataFrame:
    """Nearest container of every symbol in its file."""
    return position.outline(live_symbols(spark, root, "file_path", "start_line", "end_line", "start_col", "end_col"))


@query("""WITH p AS (SELECT DISTINCT path FROM files), h AS (SELECT p.path, j.project_id, row_number() OVER (PARTITION BY p.path ORDER BY length(j.rel_path) DESC) AS rn FROM p JOIN projects j ON NOT starts_with(j.root_path, '/checkouts/') OR starts_with(j.root_path, '/checkouts/primary')
WHERE j.rel_path = '' OR p.path = j.rel_path OR starts_with(p.path, j.rel_path || '/')) SELECT p.path, h.project_id FROM p LEFT JOIN h ON h.path = p.path AND h.rn = 1""")
def o35_file_project(spark: SparkSession, root: str) -> DataFrame:
    """Project of each file of the primary workspace by the longest relative path."""
    f = table(spark, root, "files").select("path").distinct()
    j = table(spark, root, "projects").where("root_path like '/checkouts/primary%'").select("rel_path", "project_id")
    return position.longest_prefix(f, "path", j, "rel_path").select("path", "project_id")


_ABS = "CASE WHEN starts_with(p.path, 'ws:') THEN w.root_path || '/' || regexp_replace(p.path, '^ws:[^:]*:', '') ELSE w.root_path || '/' || p.path END"


@query(f"""WITH p AS (SELECT DISTINCT path, CASE WHEN starts_with(path, 'ws:') THEN regexp_extract(path, '^ws:([^:]*):', 1) ELSE 'primary' END AS ws FROM files), a AS (SELECT p.path, {_ABS} AS abs_path FROM p JOIN workspace_catalog w ON w.workspace_id = p.ws),
h AS (SELECT a.path, j.project_id, row_number() OVER (PARTITION BY a.path ORDER BY length(j.root_path) DESC) AS rn FROM a JOIN projects j ON a.abs_path = j.root_path OR starts_with(a.abs_path, j.root_path || '/')) SELECT a.path, a.abs_path, h.project_id FROM a LEFT JOIN h ON h.path = a.path AND h.rn = 1""")
def o36_project_of_absolute_path(spark: SparkSession, root: str) -> DataFrame:
    """Deepest project above each absolute path, peers included."""
    ws = F.when(F.startswith("path", F.lit("ws:")), F.regexp_extract("path", "^ws:([^:]*):", 1)).otherwise("primary")
    f = table(spark, root, "files").select("path").distinct().withColumn("workspace_id", ws)
    w = table(spark, root, "workspace_catalog").select("workspace_id", F.col("root_path").alias("base"))
    a = f.join(w, "workspace_id").select("path", F.concat("base", F.lit("/"), F.regexp_replace("path", "^ws:[^:]*:", "")).alias("abs_path"))
    return position.longest_prefix(a, "abs_path", table(spark, root, "projects").select("root_path", "project_id"), "root_path").select("path", "abs_path", "project_id")


_BFS = f"""{GRAPH}, adj AS (SELECT from_fqdn AS node, target AS other FROM g WHERE resolved AND from_fqdn IS NOT NULL UNION SELECT target, from_fqdn FROM g WHERE resolved AND from_fqdn IS NOT NULL),
d0 AS (SELECT DISTINCT fqdn AS focal, fqdn AS node, 0 AS depth FROM live WHERE symbol_id % 50 = 0), d1 AS (SELECT DISTINCT focal, other AS node, 1 AS depth FROM d0 JOIN adj USING (node)),
s1 AS (SELECT focal, node, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) GROUP BY ALL), d2 AS (SELECT DISTINCT focal, other AS node, 2 AS depth FROM (SELECT * FROM s1 WHERE depth = 1) JOIN adj USING (node)),
seen AS (SELECT focal, node, CAST(min(depth) AS INT) AS depth FROM (SELECT * FROM s1 UNION ALL SELECT * FROM d2) GROUP BY focal, node)"""


def _walk(spark: SparkSession, root: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    s, e = live_symbols(spark, root, "symbol_id"), graph_edges(spark, root)
    focals = s.where("symbol_id % 50 = 0").select(F.col("fqdn").alias("focal"))
    return graph.neighbourhood(focals, e, s, depth=depth, max_nodes=5000), e


@query(f"WITH {_BFS} SELECT focal, node, depth FROM seen")
def o73_bfs_depth2(spark: SparkSession, root: str) -> DataFrame:
    """Two hops around every symbol whose id is divisible by 50 (the query set), over all edges."""
    return _walk(spark, root)[0].select("focal", "node", "depth")


@query(f"WITH {_BFS}, x AS (SELECT DISTINCT s.focal, g.from_fqdn, g.target AS to_fqdn, g.kind FROM seen s JOIN g ON g.resolved AND (g.from_fqdn = s.node OR g.target = s.node) WHERE s.depth < 2) SELECT x.* FROM x WHERE EXISTS (SELECT 1 FROM seen a WHERE a.focal = x.focal AND a.node = x.from_fqdn) AND EXISTS (SELECT 1 FROM seen b WHERE b.focal = x.focal AND b.node = x.to_fqdn)")
def o71_shipped_edges(spark: SparkSession, root: str) -> DataFrame:
    """Edges of the walk with both ends shipped, once per (from, to, kind)."""
    nodes, e = _walk(spark, root)
    return graph.edges_within(nodes, e, depth=2).drop("outbound")


_N500 = "n AS (SELECT DISTINCT fqdn FROM live ORDER BY fqdn LIMIT 500)"


@query(f"WITH {GRAPH}, {_N500} SELECT DISTINCT from_fqdn, target AS to_fqdn, kind FROM g WHERE resolved AND from_fqdn IN (SELECT fqdn FROM n) AND target IN (SELECT fqdn FROM n)")
def o74_bounded_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Edges among the first 500 symbols."""
    return graph.bounded(live_symbols(spark, root, "kind", "is_external"), graph_edges(spark, root))[1]


@query(f"WITH {LIVE}, {CUR}, {_N500} SELECT l.fqdn, l.kind, l.visibility, c.project_id, {IS_TEST.replace('file_path', 'l.file_path').replace('fqdn', 'l.fqdn')} AS is_test FROM live l LEFT JOIN cur c ON c.path = l.file_path WHERE l.fqdn IN (SELECT fqdn FROM n)")
def o76_node_payload(spark: SparkSession, root: str) -> DataFrame:
    s = live_symbols(spark, root, "kind", "visibility", "is_external", "file_path")
    nodes, _ = graph.bounded(s, graph_edges(spark, root))
    f = current_files(spark, root, "project_id").select(F.col("path").alias("file_path"), "project_id")
    return s.join(nodes, "fqdn", "left_semi").join(f, "file_path", "left").select("fqdn", "kind", "visibility", "project_id", expr.is_test(F.col("fqdn"), F.col("file_path")).alias("is_test"))


@query(f"""WITH {_BFS.replace('d2 AS', 'd2x AS').replace('SELECT * FROM d2)', 'SELECT * FROM d2x WHERE false)')}, x AS (SELECT DISTINCT s.focal, g.from_fqdn, g.target AS to_fqdn, g.kind FROM seen s JOIN g ON g.resolved AND (g.from_fqdn = s.node OR g.target = s.node) WHERE s.depth < 1 AND EXISTS (SELECT 1 FROM seen a WHERE a.focal = s.focal AND a.node = g.from_fqdn) AND EXISTS (SELECT 1 FROM seen b WHERE b.focal = s.focal AND b.node = g.target))
SELECT x.focal, x.from_fqdn, x.to_fqdn, x.kind, CAST(CASE WHEN x.from_fqdn = x.focal AND x.to_fqdn = x.focal THEN 0 ELSE 1 END AS INT) AS depth FROM x""")
def o79_focus_payload(spark: SparkSession, root: str) -> DataFrame:
    """Edges around each focal symbol with the larger hop distance of their ends (1 where unknown)."""
    nodes, e = _walk(spark, root, depth=1)
    shown = graph.edges_within(nodes, e, depth=1).drop("outbound")
    d = graph.undirected_depth(shown, most=1)
    a, b = d.withColumnsRenamed({"node": "from_fqdn", "depth": "da"}), d.withColumnsRenamed({"node": "to_fqdn", "depth": "db"})
    j = shown.join(a, ["focal", "from_fqdn"], "left").join(b, ["focal", "to_fqdn"], "left")
    return j.select("focal", "from_fqdn", "to_fqdn", "kind", F.greatest(F.coalesce("da", F.lit(1)), F.coalesce("db", F.lit(1))).alias("depth"))


@query(f"""WITH {LIVE}, m AS (SELECT fqdn, string_split(fqdn, '::') AS s FROM live WHERE kind = 'module'), x AS (SELECT fqdn, s, unnest(range(1, len(s) + 1)) AS d FROM m),
n AS (SELECT DISTINCT array_to_string(s[1:d], '::') AS node, CASE WHEN d > 1 THEN array_to_string(s[1:d-1], '::') END AS parent, CAST(d AS INT) AS depth FROM x) SELECT node, parent, depth, node NOT IN (SELECT fqdn FROM m) AS virtual FROM n""")
def o80_module_tree(spark: SparkSession, root: str) -> DataFrame:
    """Module tree with the ancestors that no symbol stands for."""
    m = live_symbols(spark, root, "kind").where("kind = 'module'").select("fqdn").distinct()
    n = m.select(F.explode(expr.prefixes(expr.segments(F.col("fqdn")), "::")).alias("h")).select(F.col("h.prefix").alias("node"), expr.parent(F.col("h.prefix")).alias("parent"), F.col("h.depth").alias("depth")).distinct()
    return n.join(m.withColumnRenamed("fqdn", "node").withColumn("own", F.lit(True)), "node", "left").select("node", "parent", "depth", F.col("own").isNull().alias("virtual"))


@query("""WITH p AS (SELECT DISTINCT regexp_replace(path, '^ws:[^:]*:', '') AS path FROM files), s AS (SELECT path, string_split(path, '/') AS s FROM p), x AS (SELECT s, unnest(range(1, len(s) + 1)) AS d FROM s)
SELECT array_to_string(s[1:d], '/') AS node, CAST(d AS INT) AS depth, count(*) AS files FROM x GROUP BY ALL""")
def o80_path_tree(spark: SparkSession, root: str) -> DataFrame:
    """Folder tree with the number of files below each node."""
    p = table(spark, root, "files").select(F.regexp_replace("path", "^ws:[^:]*:", "").alias("path")).distinct()
    return p.select(F.explode(expr.prefixes(F.split("path", "/"), "/")).alias("h")).groupBy(F.col("h.prefix").alias("node"), F.col("h.depth").alias("depth")).agg(F.count("*").alias("files"))


@query(f"""WITH {LIVE}, m AS (SELECT DISTINCT fqdn FROM live WHERE kind = 'module'), h AS (SELECT l.workspace_id, l.fqdn, m.fqdn AS module, row_number() OVER (PARTITION BY l.workspace_id, l.fqdn ORDER BY length(m.fqdn) DESC) AS rn FROM live l JOIN m ON l.fqdn = m.fqdn OR starts_with(l.fqdn, m.fqdn || '::'))
SELECT l.workspace_id, l.fqdn, h.module AS containing_module FROM live l LEFT JOIN h ON h.workspace_id = l.workspace_id AND h.fqdn = l.fqdn AND h.rn = 1""")
def o81_containing_module(spark: SparkSession, root: str) -> DataFrame:
    """Nearest module at or above each symbol."""
    s = live_symbols(spark, root, "kind").select("workspace_id", "fqdn")
    m = live_symbols(spark, root, "kind").where("kind = 'module'").select(F.col("fqdn").alias("containing_module")).distinct()
    return position.longest_prefix(s, "fqdn", m, "containing_module", sep="::").select("workspace_id", "fqdn", "containing_module")
