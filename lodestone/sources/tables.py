"""Readers of the graph's Parquet tables and the clean views on them that operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import spread


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The stored rows of a table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def canonical_path(path: Column) -> Column:
    """One spelling per path: forward slashes, no ``./`` steps, no doubled separators; a ``ws:<id>:`` mark stays.

    Null stays null, an empty path stays empty.
    """
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    p = F.regexp_replace(p, r"/(?:\./|/)+", "/")
    return F.regexp_replace(p, r"^((?:\./)*)(ws:[^:/]*:)?(?:\./)*", "$2")


def canonical_hash(h: Column) -> Column:
    """Content hashes compare without letter case and outer blanks."""
    return F.lower(F.trim(h))


def month(ms: Column) -> Column:
    """``yyyy-MM`` of epoch milliseconds in the session's time zone (UTC); null stays null."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")


def live_symbols(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """One row per (workspace_id, fqdn): its latest revision, if that is not a removal; only ``cols`` when given.

    Latest is by indexed_ms, then revision, then symbol_id; repeated deliveries are one row. The aggregate is a
    ``max_by``, so hot symbols are folded before the shuffle; naming columns keeps the others out of scan and shuffle.
    """
    s = table(spark, root, "symbols")
    kept = [c for c in s.columns if c not in ("workspace_id", "fqdn") and (not cols or c in cols or c == "deleted_ms")]
    latest = s.groupBy("workspace_id", "fqdn").agg(F.max_by(F.struct(*kept), F.struct("indexed_ms", "last_modified_revision", "symbol_id")).alias("r"))
    return latest.select("workspace_id", "fqdn", "r.*").where("deleted_ms is null").select("workspace_id", "fqdn", *[c for c in kept if not cols or c in cols])


def current_files(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """One row per path: the version with the greatest last_scanned_ms, ties by content_hash; only ``cols`` when given."""
    f = table(spark, root, "files")
    kept = [c for c in f.columns if c != "path" and (not cols or c in cols)]
    return f.groupBy("path").agg(F.max_by(F.struct(*kept), F.struct("last_scanned_ms", "content_hash", "byte_size")).alias("r")).select("path", "r.*")


def current_texts(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """``path``, ``content`` and ``cols`` of the current version of each path, for plans that carry texts.

    The winner of a path is found on keys alone: its row's place (file and row number) is a ``max_by``, and texts meet the
    winners by path in one join. Spark broadcasts the winners where their measured size allows, so texts don't move at all;
    beyond that they are shuffled once, by path, and whatever is joined by path afterwards finds them there.
    """
    f = table(spark, root, "files").select("path", "content", *[c for c in cols if c not in ("path", "content")], "last_scanned_ms", "content_hash", "byte_size", "_metadata.file_path", "_metadata.row_index")
    f = f.withColumnsRenamed({"file_path": "__file", "row_index": "__row"}).where("path is not null")
    place = F.struct(F.col("__file").alias("__won_file"), F.col("__row").alias("__won_row"))
    won = f.groupBy("path").agg(F.max_by(place, F.struct("last_scanned_ms", "content_hash", "byte_size", "__file", "__row")).alias("w")).select("path", "w.*")
    texts = spread(f.select("path", "content", *[c for c in cols if c not in ("path", "content")], "__file", "__row"), "path")
    return texts.join(won, "path").where("__file = __won_file and __row = __won_row").drop("__file", "__row", "__won_file", "__won_row")


def distinct_edges(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """Edges once each, however often delivered: one row per edge_id with the columns asked for."""
    e = table(spark, root, "edges").select("edge_id", *[c for c in cols if c != "edge_id"])
    return e.dropDuplicates(["edge_id"])


def distinct_calls(spark: SparkSession, root: str, *cols: str) -> DataFrame:
    """Call sites once each: one row per id with the columns asked for."""
    return table(spark, root, "call_sites").select("id", *[c for c in cols if c != "id"]).dropDuplicates(["id"])


def graph_edges(spark: SparkSession, root: str, *more: str) -> DataFrame:
    """Edges with their target worked out anew: ``target`` is the live symbol that to_symbol_id names (``resolved``), else
    the text of to_unresolved, else to_fqdn demoted to text. Deletes and renames therefore need no update of edges.

    Most edges have no to_symbol_id: the join's second key scatters those, so that null isn't one hash partition."""
    e = distinct_edges(spark, root, "workspace_id", "from_fqdn", "kind", "to_symbol_id", "to_fqdn", "to_unresolved", *more)
    ids = live_symbols(spark, root, "symbol_id").select(F.col("symbol_id").alias("to_symbol_id"), F.col("fqdn").alias("live_fqdn"))
    e = e.withColumn("__scatter", F.when(F.col("to_symbol_id").isNull(), F.xxhash64("edge_id")).otherwise(F.lit(0)))
    j = e.join(ids.withColumn("__scatter", F.lit(0).cast("bigint")), ["to_symbol_id", "__scatter"], "left").drop("__scatter")
    return j.withColumn("resolved", F.col("live_fqdn").isNotNull()).withColumn("target", F.coalesce("live_fqdn", "to_unresolved", "to_fqdn")).drop("live_fqdn")
