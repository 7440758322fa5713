"""Driver queries: extraction and source slices (operators O-06, O-39, O-84, O-87 to O-92, O-98, O-101 to O-117)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import LINE_BREAK, slice_lines
from lodestone.operators import builtins, extract, resolve, similar
from lodestone.plans.registry import CUR, EDGE, LIVE, Registry
from lodestone.plans.resolve_queries import _SCORE, _tok
from lodestone.session import ship
from lodestone.sources.tables import current_texts, distinct_edges, live_symbols, table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query


def extracted(spark: SparkSession, root: str) -> DataFrame:
    """Everything the current versions of all files yield, under their project's name."""
    p = table(spark, root, "projects").select("project_id", F.col("label").alias("project"))
    f = current_texts(spark, root, "project_id").where("content is not null")
    return extract.extract(f.join(p, "project_id", "left").select("path", "content", "project"), extract.return_types(table(spark, root, "files").select("path", "content")))


@query()
def o06_extract(spark: SparkSession, root: str) -> DataFrame:
    """Everything, edges to built-in names by their tier."""
    return extract.with_builtins(extracted(spark, root), builtins.registry(spark))


@query()
def o115_module_lookups(spark: SparkSession, root: str) -> DataFrame:
    """What every module exports and imports."""
    return extract.module_lookups(extracted(spark, root))


def _symbols(x: DataFrame, *ends: str) -> DataFrame:
    c = F.lit(False)
    for e in ends:
        c = c | F.endswith("path", F.lit(e))
    return x.where(c)


@query()
def o101_rust_symbols(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".rs").where("what = 'symbol'").select("path", "fqdn", "kind", "language_kind", "visibility", "receiver_type", "start_line", "end_line")


@query()
def o102_rust_calls(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".rs").where("(what = 'edge' and kind = 'CALLS') or what = 'call'").select("path", "what", "fqdn", "target", "receiver_type", "attribute", "start_line", "args")


@query()
def o103_rust_imports(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".rs").where("what = 'edge' and kind = 'IMPORTS'").select("path", "fqdn", "target", "attribute", "start_line")


@query()
def o104_uses_type(spark: SparkSession, root: str) -> DataFrame:
    return extracted(spark, root).where("what = 'edge' and kind = 'USES_TYPE'").select("path", "fqdn", "target", "attribute", "start_line")


@query()
def o105_implements(spark: SparkSession, root: str) -> DataFrame:
    return extracted(spark, root).where("what = 'edge' and kind in ('IMPLEMENTS', 'EXTENDS')").select("path", "fqdn", "kind", "target", "attribute")


@query(r"""WITH s AS (SELECT unnest(regexp_extract_all(content, 'fn\s+\w+\s*(?:<[^>{}]*>)?\s*\([^{};]*\)\s*->\s*[^{;]+')) AS s FROM files WHERE suffix(path, '.rs') AND content IS NOT NULL),
one AS (SELECT regexp_extract(s, 'fn\s+(\w+)', 1) AS name, regexp_extract(s, '->\s*&?(?:''\w+\s+)?(?:mut\s+)?([A-Za-z_][\w:]*)', 1) AS ty FROM s)
SELECT name, string_split(min(ty), '::')[-1] AS return_type FROM one WHERE ty <> '' GROUP BY name HAVING min(ty) = max(ty)""")
def o107_return_types(spark: SparkSession, root: str) -> DataFrame:
    """Return types of functions over the whole workspace, where a name has just one."""
    return extract.return_types(table(spark, root, "files").select("path", "content"))


@query()
def o108_script_graph(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".ts", ".tsx", ".js", ".jsx").where("what in ('symbol', 'edge')").select("path", "what", "fqdn", "kind", "language_kind", "target", "start_line")


@query()
def o110_lua_graph(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".lua").where("what in ('symbol', 'edge')").select("path", "what", "fqdn", "kind", "language_kind", "target", "start_line")


@query()
def o111_c_graph(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".c", ".h").where("what in ('symbol', 'edge')").select("path", "what", "fqdn", "kind", "language_kind", "target", "start_line")


@query()
def o112_component_graph(spark: SparkSession, root: str) -> DataFrame:
    return _symbols(extracted(spark, root), ".vue", ".svelte").where("what in ('symbol', 'edge')").select("path", "what", "fqdn", "kind", "target", "attribute", "start_line")


@query()
def o113_documents(spark: SparkSession, root: str) -> DataFrame:
    return extracted(spark, root).where("what = 'doc'").select("path", "fqdn", F.col("target").alias("description"))


@query()
def o114_foreign_bindings(spark: SparkSession, root: str) -> DataFrame:
    return extracted(spark, root).where("what = 'ffi'").select("path", "fqdn", F.col("kind").alias("direction"), F.col("attribute").alias("abi"), F.col("target").alias("abi_name"))


@query()
def o39_foreign_links(spark: SparkSession, root: str) -> DataFrame:
    """Importers linked with the one exporter of their name."""
    b = o114_foreign_bindings(spark, root).withColumn("workspace_id", F.when(F.startswith("path", F.lit("ws:")), F.regexp_extract("path", "^ws:([^:]*):", 1)).otherwise("primary"))
    e = distinct_edges(spark, root, "workspace_id", "from_fqdn", "kind", "to_fqdn")
    return resolve.foreign_links(b, e)


@query()
def o117_entry_points(spark: SparkSession, root: str) -> DataFrame:
    return extracted(spark, root).where("what = 'symbol' and entry_point is not null").select("path", "fqdn", "entry_point")


@query(f"""WITH {LIVE}, {EDGE}, s AS (SELECT DISTINCT fqdn, name FROM live WHERE workspace_id = 'primary' AND name IS NOT NULL), n AS (SELECT name, lower(name) AS low, {_tok('name')} AS t FROM (SELECT DISTINCT name FROM s)),
r AS (SELECT DISTINCT regexp_replace(to_unresolved, '[*?\\[\\]]', '', 'g') AS name FROM e1 WHERE to_unresolved IS NOT NULL AND edge_id % 50 = 0), q AS (SELECT name, lower(name) AS low, {_tok('name')} AS t FROM r WHERE length(name) > 0 AND name NOT IN (SELECT name FROM s)),
p AS (SELECT a.name AS query, b.name, {_SCORE} AS score FROM q a JOIN n b ON a.low <> b.low) SELECT query, fqdn, score FROM p JOIN s USING (name) WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, fqdn) <= 5""")
def o84_did_you_mean(spark: SparkSession, root: str) -> DataFrame:
    """Suggestions for the unresolved names of edges whose id is divisible by 50 (the query set)."""
    s = live_symbols(spark, root, "name").where("workspace_id = 'primary' and name is not null").select("fqdn", "name").distinct()
    r = distinct_edges(spark, root, "to_unresolved").where("to_unresolved is not null and edge_id % 50 = 0").select(F.col("to_unresolved").alias("name"))
    return similar.did_you_mean(r, s).drop("rank")


#: Lines of a file whose symbols are cut together.
SPAN_BLOCK = 4096


def _spans(spark: SparkSession, root: str) -> DataFrame:
    """``content`` with ``spans`` (workspace_id, fqdn, from, lines): the live symbols of each file, in blocks of SPAN_BLOCK
    lines, so that a text is joined and cut into lines once per block and not once per symbol."""
    s = live_symbols(spark, root, "kind", "file_path", "start_line", "end_line").where("kind <> 'module' and start_line is not null and end_line is not null and file_path is not null")
    span = F.struct("workspace_id", "fqdn", F.col("start_line").alias("from"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).alias("lines"))
    per = s.groupBy(F.col("file_path").alias("path"), F.floor(F.col("start_line") / SPAN_BLOCK).alias("block")).agg(F.collect_list(span).alias("spans"))
    return current_texts(spark, root).where("content is not null").join(per, "path").select("content", "spans")


@query(f"WITH {LIVE}, {CUR}, l AS (SELECT l.workspace_id, l.fqdn, regexp_split_to_array(c.content, '\\r?\\n')[l.start_line:l.end_line] AS s FROM live l JOIN cur c ON c.path = l.file_path WHERE c.content IS NOT NULL AND l.kind <> 'module' AND l.start_line IS NOT NULL AND l.end_line IS NOT NULL) SELECT workspace_id, fqdn, array_to_string(s, chr(10)) AS body, CAST(len(s) AS INT) AS total_lines FROM l")
def o87_body_slices(spark: SparkSession, root: str) -> DataFrame:
    """Source lines of every live symbol, cut JVM-side; a text is split once for all its symbols."""
    lines = _spans(spark, root).select("spans", F.split("content", r"\r?\n").alias("lines"))
    cut = F.transform("spans", lambda x: F.struct(x["workspace_id"].alias("workspace_id"), x["fqdn"].alias("fqdn"), F.slice(F.col("lines"), x["from"], F.least(x["lines"], F.size("lines"))).alias("s")))
    return lines.select(F.inline(cut)).select("workspace_id", "fqdn", F.array_join("s", "\n").alias("body"), F.size("s").alias("total_lines"))


def _body(spark: SparkSession, root: str, **options) -> DataFrame:
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for content, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = LINE_BREAK.split(content)
                rows += [(s["workspace_id"], s["fqdn"], slice_lines(lines[s["from"] - 1 : s["from"] - 1 + s["lines"]] if s["from"] > 0 else [], **options)) for s in spans]
            yield pa.RecordBatch.from_pydict({"workspace_id": [r[0] for r in rows], "fqdn": [r[1] for r in rows], **{k: [r[2][k] for r in rows] for k in ("body", "stripped_lines", "truncated", "dedented_prefix_len", "indent_unit")}}, schema=_BODY)

    return _spans(spark, root).mapInArrow(run, "workspace_id string, fqdn string, body string, stripped_lines int, truncated boolean, dedented_prefix_len int, indent_unit string")


_BODY = pa.schema([("workspace_id", pa.string()), ("fqdn", pa.string()), ("body", pa.string()), ("stripped_lines", pa.int32()), ("truncated", pa.bool_()), ("dedented_prefix_len", pa.int32()), ("indent_unit", pa.string())])


@query()
def o88_body_without_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Bodies without leading comments and attributes, indents compacted to tabs (O-88, O-91, O-92)."""
    return _body(spark, root, strip_attrs=True)


@query()
def o89_code_only(spark: SparkSession, root: str) -> DataFrame:
    """Bodies without comments, blank runs collapsed (O-89, O-90)."""
    return _body(spark, root, strip_attrs=True, strip_inline=True, collapse=True)


@query()
def o91_signature_lines(spark: SparkSession, root: str) -> DataFrame:
    """Bodies cut behind their first opening brace, at most 40 lines."""
    return _body(spark, root, strip_attrs=True, signature_only=True, max_lines=40)
