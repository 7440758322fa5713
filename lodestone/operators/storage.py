"""Storage verbs as snapshot functions: peers and their catalog, projects, enrichments, positions, the stored search index.

Each takes the tables as they are and returns them as they are afterwards, so a retry gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators.incremental import delete_by, ignored, upsert
from lodestone.operators.lookup import postings
from lodestone.operators.order import dense_ids

#: What a confidence may be, and the directions of a link.
CONFIDENCES = ("low", "medium", "high")
DIRECTIONS = (0, 1, 2)


# -- linked workspaces -------------------------------------------------------------------------------------------------


def register(catalog: DataFrame, new: DataFrame) -> DataFrame:
    """The catalog with new links (workspace_id, root_path, ...): ids must be new, roots may repeat."""
    return catalog.unionByName(new.join(catalog.select("workspace_id"), "workspace_id", "left_anti"), allowMissingColumns=True).select(*catalog.columns)


def set_fields(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """The catalog with the non-null fields of ``changes`` (workspace_id and any of its columns) put in; a direction that
    isn't one is left out, unknown ids change nothing."""
    fields = [c for c in changes.columns if c != "workspace_id" and c in catalog.columns]
    renamed = changes.select("workspace_id", *[F.col(c).alias(f"__{c}") for c in fields])
    j = catalog.join(renamed, "workspace_id", "left")
    value = {c: F.coalesce(F.when(F.col(f"__{c}").isin(*DIRECTIONS), F.col(f"__{c}")) if c == "link_direction" else F.col(f"__{c}"), F.col(c)) for c in fields}
    return j.select(*[value[c].alias(c) if c in value else F.col(c) for c in catalog.columns])


def unlink(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the workspaces in ``gone``; the primary one can't be unlinked."""
    keys = gone.where("workspace_id <> 'primary'").select("workspace_id")
    return {k: delete_by(d, keys, ["workspace_id"]) for k, d in tables.items()}


def refresh(rows: DataFrame, peer: DataFrame, workspace_id: str) -> DataFrame:
    """A peer's rows replaced by its index as it is now (already scoped by ``import_peer``)."""
    return rows.where(F.col("workspace_id") != workspace_id).unionByName(peer.where(F.col("workspace_id") == workspace_id).select(*rows.columns))


# -- files and projects ------------------------------------------------------------------------------------------------


def delete_plan(files: DataFrame, layers: list[tuple[str, list[str]]], listed: DataFrame) -> DataFrame:
    """path, action: ``delete`` for listed paths, ``ignore`` for those that now match ignore rules, ``rescan`` for those without
    a content, ``keep`` for the rest; the first that fits."""
    f = files.select("path", F.col("content_hash").isNull().alias("bare")).join(listed.select("path", F.lit(True).alias("listed")).distinct(), "path", "left")
    return f.select("path", F.when(F.col("listed"), "delete").when(ignored(F.col("path"), layers), "ignore").when(F.col("bare"), "rescan").otherwise("keep").alias("action"))


def delete_projects(projects: DataFrame, files: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(projects, files) after deleting projects: their files stay and lose the reference."""
    gone = projects.where(where).select("project_id", F.lit(True).alias("__gone"))
    f = files.join(gone, "project_id", "left")
    f = f.withColumn("project_id", F.when(F.col("__gone").isNull(), F.col("project_id"))).select(*files.columns)
    return delete_by(projects, gone, ["project_id"]), f


def upsert_projects(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Projects by root_path: a known root keeps its id and takes the other fields, a new one gets the next ids in order."""
    known = projects.select("root_path", F.col("project_id").alias("__id"))
    top = projects.agg(F.coalesce(F.max("project_id"), F.lit(0)).alias("__top"))
    fresh = new.join(known, "root_path", "left_anti").select("root_path").distinct()
    numbered = dense_ids(fresh, ["root_path"], "__pos").crossJoin(F.broadcast(top))
    ids = known.unionByName(numbered.select("root_path", (F.col("__top") + F.col("__pos") + 1).cast("int").alias("__id")))
    rows = new.join(ids, "root_path").withColumn("project_id", F.col("__id")).select(*projects.columns)
    return upsert(projects, rows, ["project_id"])


def rediscover(projects: DataFrame, found: DataFrame, files: DataFrame, changed: DataFrame, manifests: list[str]) -> tuple[DataFrame, DataFrame]:
    """(projects, files with project_id) after paths changed: when a manifest is among them, projects are what discovery
    ``found`` (rel_path, kind, label) and every file goes to the deepest project folder above it; else nothing changes."""
    hit = changed.where(F.regexp_extract("path", "([^/]*)$", 1).isin(*manifests)).groupBy().agg((F.count("*") > 0).alias("hit"))
    p = upsert_projects(projects, found.select(F.lit(None).cast("int").alias("project_id"), "label", "kind", F.col("rel_path").alias("root_path"), "rel_path").select(*projects.columns))
    kept = p.join(found.select("rel_path"), "rel_path", "left_semi").select(*projects.columns)
    after = kept.crossJoin(F.broadcast(hit)).where("hit").drop("hit").unionByName(projects.crossJoin(F.broadcast(hit)).where("not hit").drop("hit"))
    heads = files.select("path", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("prefix"))), expr.prefixes(F.split("path", "/"), "/"))).alias("h")).select("path", "h.depth", F.col("h.prefix").alias("rel_path"))
    homes = heads.join(after.select("rel_path", "project_id"), "rel_path").groupBy("path").agg(F.max_by("project_id", "depth").alias("project_id"))
    moved = files.drop("project_id").join(homes, "path", "left").select(*files.columns)
    return after, moved.crossJoin(F.broadcast(hit)).where("hit").drop("hit").unionByName(files.crossJoin(F.broadcast(hit)).where("not hit").drop("hit"))


# -- rows about symbols ------------------------------------------------------------------------------------------------


def enrich(old: DataFrame, new: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Enrichments (workspace_id, fqdn, ..., confidence) after an upsert; rows whose confidence is none are refused."""
    return upsert(old, new.where(F.col("confidence").isin(*CONFIDENCES)), ["workspace_id", "fqdn"], order=order)


def move_positions(symbols: DataFrame, new: DataFrame, key: list[str], position: tuple[str, ...] = ("start_line", "end_line", "start_col", "end_col")) -> DataFrame:
    """Symbols with new positions where ``new`` has one, field by field; nothing else changes, the revision least of all."""
    n = new.select(*key, *[F.col(c).alias(f"__{c}") for c in position])
    return symbols.join(n, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in position else F.col(c) for c in symbols.columns])


def meta(symbols: DataFrame, catalog: DataFrame, schema_version: int = 1) -> DataFrame:
    """workspace_id, revision, next_revision, schema_version, kind: one row per workspace of the catalog."""
    rev = symbols.groupBy("workspace_id").agg(F.max("last_modified_revision").alias("revision"))
    j = catalog.select("workspace_id").distinct().join(rev, "workspace_id", "left").withColumn("revision", F.coalesce("revision", F.lit(0).cast("bigint")))
    return j.select("workspace_id", "revision", (F.col("revision") + 1).alias("next_revision"), F.lit(schema_version).alias("schema_version"), F.when(F.col("workspace_id") == "primary", "primary").otherwise("linked").alias("kind"))


def index_check(symbols: DataFrame, stored: DataFrame, text: Column) -> DataFrame:
    """term, documents, stored_documents, sound: the terms of the symbols as they are beside the stored index."""
    now = postings(symbols, ["workspace_id", "fqdn"], text).groupBy("term").agg(F.count("*").alias("documents"))
    then = stored.groupBy("term").agg(F.count("*").alias("stored_documents"))
    j = now.join(then, "term", "full_outer").select("term", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("documents", "stored_documents")])
    return j.withColumn("sound", F.col("documents") == F.col("stored_documents"))
