"""Driver queries: lookups, listings, filters, search (operators O-02, O-09, O-14 to O-28, O-47)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators import lookup
from lodestone.plans.registry import CALL, CUR, EDGE, LIVE, Registry
from lodestone.sources.tables import current_files, distinct_calls, distinct_edges, live_symbols

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

_TESTF = "(contains(fqdn,'::tests::') OR contains(fqdn,'::test::') OR suffix(fqdn,'_test') OR suffix(fqdn,'_tests') OR suffix(fqdn,'.test') OR suffix(fqdn,'.spec') OR suffix(fqdn,'::tests') OR suffix(fqdn,'::test'))"
_P = "replace(file_path,'\\','/')"
_TESTP = f"(contains({_P},'/tests/') OR contains({_P},'/test/') OR contains({_P},'/__tests__/') OR suffix({_P},'_test.rs') OR suffix({_P},'_tests.rs') OR regexp_matches({_P}, '\\.(test|spec)\\.(ts|tsx|js|jsx)$'))"
IS_TEST = f"(coalesce({_TESTF},false) OR coalesce({_TESTP},false))"
_LANG = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in expr.EXTENSIONS.items()) + " END"


@query(f"WITH p AS (SELECT DISTINCT path, regexp_extract(path, '\\.([^./]+)$', 1) AS ext FROM files) SELECT path, ext, {_LANG} AS language, {_LANG} IS NOT NULL AS supported FROM p")
def o02_language_of_path(spark: SparkSession, root: str) -> DataFrame:
    """Extension gate and language of each path."""
    p = spark.read.parquet(f"{root}/files.parquet").select("path").distinct()
    lang = expr.language_of_path(F.col("path"))
    return p.select("path", expr.extension(F.col("path")).alias("ext"), lang.alias("language"), lang.isNotNull().alias("supported"))


@query(f"WITH {CUR} SELECT path, content_hash, language, byte_size, last_scanned_ms, last_scan_error FROM cur")
def o09_file_info(spark: SparkSession, root: str) -> DataFrame:
    return current_files(spark, root, "content_hash", "language", "byte_size", "last_scanned_ms", "last_scan_error").select("path", "content_hash", "language", "byte_size", "last_scanned_ms", "last_scan_error")


@query(f"WITH {LIVE}, r AS (SELECT DISTINCT workspace_id, from_fqdn AS fqdn FROM edges WHERE from_fqdn IS NOT NULL) SELECT r.workspace_id, r.fqdn, l.kind, l.file_path, l.start_line, l.fqdn IS NOT NULL AS found FROM r LEFT JOIN live l ON l.workspace_id = r.workspace_id AND l.fqdn = r.fqdn")
def o14_lookup_fqdn(spark: SparkSession, root: str) -> DataFrame:
    """Exact lookup of every source of an edge."""
    r = spark.read.parquet(f"{root}/edges.parquet").where("from_fqdn is not null").select("workspace_id", F.col("from_fqdn").alias("fqdn")).distinct()
    return lookup.lookup(r, live_symbols(spark, root, "kind", "file_path", "start_line"), "kind", "file_path", "start_line")


@query(f"WITH {LIVE}, r AS (SELECT DISTINCT regexp_extract(callee_text, '([^.:]*)$', 1) AS name FROM call_sites WHERE callee_text IS NOT NULL) SELECT name, fqdn, rank FROM (SELECT r.name, l.fqdn, CAST(row_number() OVER (PARTITION BY r.name ORDER BY l.fqdn, l.workspace_id) AS INT) AS rank FROM r JOIN live l ON l.name = r.name) WHERE rank <= 20")
def o15_symbols_by_name(spark: SparkSession, root: str) -> DataFrame:
    """Up to 20 symbols per name that is called anywhere, in any workspace."""
    r = spark.read.parquet(f"{root}/call_sites.parquet").where("callee_text is not null").select(F.regexp_extract("callee_text", r"([^.:]*)$", 1).alias("name")).distinct()
    hits = live_symbols(spark, root, "name").select("name", "fqdn", "workspace_id").join(r, "name", "left_semi")
    return lookup.first_per(hits, ["name"], ["fqdn", "workspace_id"], 20).select("name", "fqdn", "rank")


@query(f"WITH {LIVE} SELECT file_path, fqdn, start_line, start_col, CAST(row_number() OVER (PARTITION BY file_path ORDER BY start_line, start_col, fqdn, workspace_id) AS INT) AS ordinal FROM live WHERE file_path IS NOT NULL")
def o16_symbols_by_file(spark: SparkSession, root: str) -> DataFrame:
    s = live_symbols(spark, root, "file_path", "start_line", "start_col").where("file_path is not null").select("file_path", "fqdn", "start_line", "start_col", "workspace_id")
    return lookup.first_per(s, ["file_path"], ["start_line", "start_col", "fqdn", "workspace_id"], 2_000_000_000).select("file_path", "fqdn", "start_line", "start_col", F.col("rank").alias("ordinal"))


@query(f"WITH {LIVE} SELECT fqdn, kind, visibility, module FROM live WHERE kind = 'callable' AND visibility = 'public' AND workspace_id = 'primary' AND NOT coalesce(is_external, false)")
def o17_filtered(spark: SparkSession, root: str) -> DataFrame:
    return live_symbols(spark, root, "kind", "visibility", "module", "is_external").where(lookup.symbol_filter("callable", "public", include_external=False)).select("fqdn", "kind", "visibility", "module")


@query(f"WITH {LIVE} SELECT fqdn, name FROM live WHERE workspace_id = 'primary' AND (name GLOB '[a-m]*_?????' OR fqdn GLOB '[a-m]*_?????') ORDER BY fqdn LIMIT 100")
def o18_pattern(spark: SparkSession, root: str) -> DataFrame:
    """Glob over name or path, first 100 by path."""
    p = "[a-m]*_?????"
    s = live_symbols(spark, root, "name").where(F.col("workspace_id") == "primary")
    return s.where(expr.glob(F.col("name"), p) | expr.glob(F.col("fqdn"), p)).orderBy("fqdn").limit(100).select("fqdn", "name")


@query(f"WITH {LIVE}, p AS (SELECT fqdn, kind FROM live WHERE workspace_id = 'primary' AND fqdn > 'graphite' ORDER BY fqdn LIMIT 100) SELECT fqdn, kind, CASE WHEN (SELECT count(*) FROM p) = 100 THEN (SELECT max(fqdn) FROM p) END AS next_cursor FROM p")
def o19_page(spark: SparkSession, root: str) -> DataFrame:
    """A keyset page behind a cursor."""
    return lookup.page(live_symbols(spark, root, "kind"), lookup.symbol_filter(), "graphite").select("fqdn", "kind", "next_cursor")


_ASK = ["render pattern", "graphite core cursor", "unlink", "zebra snapshot", "nothing at all like it", "Caché Span"]
_TERMS = "list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


@query(f"""WITH {LIVE}, d AS (SELECT workspace_id, fqdn, {_TERMS.format("concat_ws(' ', name, fqdn)")} AS terms FROM live WHERE workspace_id = 'primary'),
q AS (SELECT i AS request_id, list_distinct({_TERMS.format('q')}) AS terms FROM (VALUES {', '.join(f"({i}, '{q}')" for i, q in enumerate(_ASK))}) t(i, q)),
qt AS (SELECT request_id, len(terms) AS want, unnest(terms) AS term FROM q), s AS (SELECT count(*) AS docs, avg(len(terms)) AS avgdl FROM d WHERE len(terms) > 0),
p AS (SELECT workspace_id, fqdn, len(any_value(terms)) AS doc_len, term, count(*) AS tf FROM (SELECT workspace_id, fqdn, terms, unnest(terms) AS term FROM d) GROUP BY workspace_id, fqdn, term),
f AS (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM qt) GROUP BY term),
h AS (SELECT request_id, fqdn, sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avgdl))) AS score, count(*) AS have, any_value(want) AS want FROM p JOIN qt USING (term) JOIN f USING (term), s GROUP BY request_id, fqdn, workspace_id),
k AS (SELECT *, max(CASE WHEN have = want THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS any_full FROM h)
SELECT CAST(request_id AS INT) AS request_id, fqdn, round(score, 4) AS score FROM k WHERE have = want OR any_full = 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, fqdn) <= 20""")
def o20_search(spark: SparkSession, root: str) -> DataFrame:
    """Full-text search with BM25: all terms, else any."""
    req = spark.createDataFrame(list(enumerate(_ASK)), "request_id int, query string")
    docs = live_symbols(spark, root, "name").where("workspace_id = 'primary'").select("fqdn", "name")
    return lookup.search(docs, ["fqdn"], F.concat_ws(" ", "name", "fqdn"), req).select("request_id", "fqdn", F.round("score", 4).alias("score"))


@query(f"WITH {LIVE} SELECT workspace_id, fqdn, {IS_TEST} AS is_test, coalesce(({_TESTF} AND NOT ((suffix(fqdn,'::tests') OR suffix(fqdn,'::test')) AND NOT (contains(fqdn,'::tests::') OR contains(fqdn,'::test::')))), false) AS neighbour_test FROM live")
def o21_test_heuristic(spark: SparkSession, root: str) -> DataFrame:
    s = live_symbols(spark, root, "file_path")
    return s.select("workspace_id", "fqdn", expr.is_test(F.col("fqdn"), F.col("file_path")).alias("is_test"), expr.test_like_fqdn(F.col("fqdn"), neighbour=True).alias("neighbour_test"))


@query(f"WITH {LIVE} SELECT fqdn FROM (SELECT fqdn, file_path FROM live WHERE workspace_id = 'primary' AND kind = 'callable' ORDER BY fqdn LIMIT 100) WHERE NOT {IS_TEST}")
def o22_exclude_tests_after_limit(spark: SparkSession, root: str) -> DataFrame:
    """Tests leave the page after it was cut, so short pages are normal."""
    p = live_symbols(spark, root, "kind", "file_path").where(lookup.symbol_filter("callable")).orderBy("fqdn").limit(100)
    return p.where(~expr.is_test(F.col("fqdn"), F.col("file_path"))).select("fqdn")


@query(f"WITH {LIVE}, {CUR} SELECT l.workspace_id, l.fqdn, l.kind, c.project_id, {IS_TEST.replace('file_path', 'l.file_path')} AS is_test FROM live l LEFT JOIN cur c ON c.path = l.file_path")
def o23_projected(spark: SparkSession, root: str) -> DataFrame:
    """Listing with the file's project and the test flag."""
    f = current_files(spark, root, "project_id").select(F.col("path").alias("file_path"), "project_id")
    return live_symbols(spark, root, "kind", "file_path").join(f, "file_path", "left").select("workspace_id", "fqdn", "kind", "project_id", expr.is_test(F.col("fqdn"), F.col("file_path")).alias("is_test"))


@query(f"WITH {LIVE} SELECT fqdn, CASE WHEN fqdn = 'graphite_core' THEN '' WHEN starts_with(fqdn, 'graphite_core::') THEN substring(fqdn, 16) ELSE fqdn END AS relative, kind FROM live WHERE workspace_id = 'primary'")
def o24_slim_relative(spark: SparkSession, root: str) -> DataFrame:
    return live_symbols(spark, root, "kind").where("workspace_id = 'primary'").select("fqdn", expr.relative_to(F.col("fqdn"), "graphite_core").alias("relative"), "kind")


@query(f"WITH {LIVE}, n AS (SELECT *, count(*) OVER (PARTITION BY name) AS hits FROM live) SELECT name, fqdn, kind, CASE WHEN hits <= 15 THEN file_path END AS file_path, CASE WHEN hits <= 15 THEN start_line END AS start_line, hits > 15 AS lean FROM n")
def o25_lean_rows(spark: SparkSession, root: str) -> DataFrame:
    """More than 15 hits of a name switch its rows to the lean form. Counts are joined back, so a frequent name isn't
    gathered in one task."""
    s = live_symbols(spark, root, "name", "kind", "file_path", "start_line").select("name", "fqdn", "kind", "file_path", "start_line")
    n = s.groupBy(F.col("name").alias("n")).agg((F.count("*") > 15).alias("lean"))
    j = s.join(n, F.col("name").eqNullSafe(F.col("n")))
    return j.select("name", "fqdn", "kind", *[F.when(~F.col("lean"), F.col(c)).alias(c) for c in ("file_path", "start_line")], "lean")


@query(f"WITH {LIVE}, r AS (SELECT DISTINCT callee_text AS fqdn FROM call_sites WHERE callee_text IS NOT NULL UNION SELECT DISTINCT to_unresolved FROM edges WHERE to_unresolved IS NOT NULL), k AS (SELECT DISTINCT fqdn AS k FROM live) SELECT r.fqdn, coalesce(a.k, b.k) AS hit FROM r LEFT JOIN k a ON a.k = r.fqdn LEFT JOIN k b ON b.k = replace(r.fqdn, '.', '::')")
def o26_fallback(spark: SparkSession, root: str) -> DataFrame:
    """Names as written, then with dots read as path separators."""
    c = spark.read.parquet(f"{root}/call_sites.parquet").select(F.col("callee_text").alias("fqdn"))
    e = spark.read.parquet(f"{root}/edges.parquet").select(F.col("to_unresolved").alias("fqdn"))
    return lookup.with_fallback(c.unionByName(e).where("fqdn is not null").distinct(), live_symbols(spark, root, "kind"))


@query(f"WITH {CALL} SELECT id, from_fqdn, callee_text, file_path, line FROM c1 WHERE callee_text GLOB 'self.*_*' OR callee_text GLOB 'self.*.?????' ORDER BY id LIMIT 200")
def o27_call_sites(spark: SparkSession, root: str) -> DataFrame:
    """Call sites by pattern, oldest first, at most 200."""
    c = distinct_calls(spark, root, "from_fqdn", "callee_text", "file_path", "line")
    return c.where(expr.glob(F.col("callee_text"), "self.*_*") | expr.glob(F.col("callee_text"), "self.*.?????")).orderBy("id").limit(200)


@query(f"WITH {LIVE}, {EDGE} SELECT workspace_id, fqdn, kind FROM live l WHERE EXISTS (SELECT 1 FROM e1 e WHERE e.to_symbol_id = l.symbol_id)")
def o47_referenced_symbols(spark: SparkSession, root: str) -> DataFrame:
    """Semi-join by a key list: symbols that an edge points at."""
    e = distinct_edges(spark, root, "to_symbol_id").where("to_symbol_id is not null").select(F.col("to_symbol_id").alias("symbol_id"))
    return live_symbols(spark, root, "kind", "symbol_id").join(e, "symbol_id", "left_semi").select("workspace_id", "fqdn", "kind")
