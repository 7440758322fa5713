"""References to records that do not exist.

References are brought into one long form ``table_name, record_id, field_name, scope, key, recorded_ms``; scope says where
the key must exist (a workspace, ``*`` for any, ``#`` for symbol ids). Distinct keys are left-anti-joined with the parents'
distinct keys, and the orphan keys are joined back to their references.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.heavy import hot_keys, skew_safe_semi
from lodestone.sources.tables import month, table

ANY, BY_ID = "*", "#"


def references(edges: DataFrame, call_sites: DataFrame) -> DataFrame:
    """Every non-null reference of the two tables, long form. Short names in to_unresolved are no references.

    Each table is scanned once; an edge's up to three references leave through one ``explode``.
    """
    def ref(field: str, scope, key):
        return F.struct(F.lit(field).alias("field_name"), scope.alias("scope"), key.cast("string").alias("key"))

    e = F.array(
        ref("from_fqdn", F.col("workspace_id"), F.col("from_fqdn")),
        ref("to_symbol_id", F.lit(BY_ID), F.col("to_symbol_id")),
        ref("to_unresolved", F.col("workspace_id"), F.when(F.contains("to_unresolved", F.lit("::")), F.col("to_unresolved"))),
    )
    from_edges = edges.select(F.lit("edges").alias("table_name"), F.col("edge_id").alias("record_id"), "recorded_ms", F.inline(F.filter(e, lambda x: x["key"].isNotNull())))
    from_calls = call_sites.where("from_fqdn is not null").select(
        F.lit("call_sites").alias("table_name"), F.col("id").alias("record_id"), "recorded_ms",
        F.lit("from_fqdn").alias("field_name"), F.lit(ANY).alias("scope"), F.col("from_fqdn").alias("key"),
    )
    return from_edges.unionByName(from_calls)


def parent_keys(symbols: DataFrame) -> DataFrame:
    """scope, key of each symbol with at least one row that is not a removal: in its workspace, in any, and by id."""
    s = symbols.where("deleted_ms is null").select("workspace_id", "fqdn", "symbol_id").distinct()
    keys = F.array(
        F.struct(F.col("workspace_id").alias("scope"), F.col("fqdn").alias("key")),
        F.struct(F.lit(ANY).alias("scope"), F.col("fqdn").alias("key")),
        F.struct(F.lit(BY_ID).alias("scope"), F.col("symbol_id").cast("string").alias("key")),
    )
    return s.select(F.inline(keys)).where("key is not null")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose (scope, key) no parent has, one row per stored reference.

    A null scope matches no workspace, so such a reference is an orphan. The keys fold to one row with its count map-side
    before the anti-join's shuffle; the join back goes through :func:`skew_safe_semi`, which spreads an orphan key that
    holds a third of all references over all shuffle partitions.
    """
    keys = refs.groupBy(F.coalesce("scope", F.lit("")).alias("scope"), "key").agg(F.count("*").alias("n"))
    orphans = keys.join(parents.where("scope is not null"), ["scope", "key"], "left_anti")
    return skew_safe_semi(refs.withColumn("scope", F.coalesce("scope", F.lit(""))), orphans, ["scope", "key"], spread=F.col("record_id"), hot=hot_keys(orphans, ["scope", "key"]))


def graph_orphans(spark: SparkSession, root: str) -> DataFrame:
    edges = table(spark, root, "edges").select("workspace_id", "edge_id", "from_fqdn", "to_symbol_id", "to_unresolved", "recorded_ms")
    calls = table(spark, root, "call_sites").select("id", "from_fqdn", "recorded_ms")
    symbols = table(spark, root, "symbols").select("workspace_id", "fqdn", "symbol_id", "deleted_ms")
    return orphan_references(references(edges, calls), parent_keys(symbols))


def orphan_records(found: DataFrame) -> DataFrame:
    """Distinct (table_name, record_id, field_name)."""
    return found.select("table_name", "record_id", "field_name").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references per table, field and month; a record counts once however often it was delivered."""
    once = found.groupBy("table_name", "field_name", "record_id").agg(F.min("recorded_ms").alias("ms"), F.first("key").alias("key"))
    return once.groupBy("table_name", "field_name", month(F.col("ms")).alias("period")).agg(F.count("*").alias("orphans"), F.countDistinct("key").alias("missing_keys"))
