"""Edges around symbols: outbound, inbound, counts and groups per direction, callers known only by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators.lookup import first_per

#: Bucket of an edge kind seen from its source and from its target.
OUT = {"CALLS": "callees", "IMPORTS": "imports"}
IN = {"CALLS": "callers", "IMPORTS": "imported_by"}
COUNTED = ("callers", "callees", "imports", "imported_by", "dependents", "tests")


def _bucket(kind, table: dict[str, str], rest: str):
    out = None
    for k, v in table.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(rest)


def outbound(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave the symbols (workspace_id, fqdn), with ``bucket`` and the neighbour's text."""
    s = symbols.select("workspace_id", F.col("fqdn").alias("from_fqdn"))
    e = edges.join(s, ["workspace_id", "from_fqdn"], "left_semi")
    return e.select("workspace_id", F.col("from_fqdn").alias("fqdn"), "edge_id", "kind", F.col("target").alias("neighbour"), "resolved", _bucket(F.col("kind"), OUT, "depends_on").alias("bucket"))


def inbound(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that point at the symbols, resolved or by the same text: one equality on the target, no OR. A name that no
    symbol has still gets its edges when it is among ``symbols``."""
    s = symbols.select(F.col("fqdn").alias("target")).distinct()
    e = edges.join(s, "target", "left_semi")
    return e.select("workspace_id", F.col("target").alias("fqdn"), "edge_id", "kind", F.col("from_fqdn").alias("neighbour"), F.lit(True).alias("resolved"), _bucket(F.col("kind"), IN, "dependents").alias("bucket"))


def grouped(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """fqdn, bucket, neighbour, edge_id: all groups of a symbol's context; tests are callers and dependents once more."""
    o = outbound(symbols, edges).select("fqdn", "bucket", "neighbour", "edge_id")
    i = inbound(symbols, edges).select("fqdn", "bucket", "neighbour", "edge_id")
    t = i.where(F.col("bucket").isin("callers", "dependents") & expr.test_like_fqdn(F.col("neighbour"), neighbour=True)).withColumn("bucket", F.lit("tests"))
    return o.unionByName(i).unionByName(t)


def summary(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """fqdn with the counts per direction, zero where there is none. Partial sums before the shuffle."""
    g = grouped(symbols, edges).where(F.col("bucket").isin(*COUNTED))
    counts = g.groupBy("fqdn").agg(*[F.sum((F.col("bucket") == b).cast("bigint")).alias(b) for b in COUNTED])
    s = symbols.select("fqdn").distinct()
    return s.join(counts, "fqdn", "left").select("fqdn", *[F.coalesce(b, F.lit(0).cast("bigint")).alias(b) for b in COUNTED])


def top_of_bucket(groups: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct neighbours of each group by name, with how many more there are."""
    d = groups.select("fqdn", "bucket", "neighbour").distinct()
    more = d.groupBy("fqdn", "bucket").agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first_per(d, ["fqdn", "bucket"], ["neighbour"], n).join(more, ["fqdn", "bucket"]).select("fqdn", "bucket", "neighbour", "rank", "more")


def textual_callers(requests: DataFrame, calls: DataFrame, known: DataFrame, cap: int = 25, fetch: int = 200) -> DataFrame:
    """fqdn, from_fqdn, id: who mentions a callable's name in a call's text without being a resolved caller.

    requests: fqdn, name. known: fqdn, from_fqdn of resolved callers. A name may stand anywhere in the text, so each
    distinct text is cut into all its substrings of the lengths that occur, and those are joined by equality; per request
    the ``fetch`` oldest sites are looked at, then one per caller, at most ``cap``. Those are among the ``fetch`` oldest
    sites of each text, and only these meet the requests, however often a text occurs.
    """
    r = requests.where("length(trim(name)) > 0").select("fqdn", F.trim("name").alias("name"))
    sizes = r.groupBy().agg(F.sort_array(F.collect_set(F.length("name"))).alias("sizes"))
    texts = calls.where("callee_text is not null").select("callee_text").distinct().crossJoin(F.broadcast(sizes))
    cuts = texts.select("callee_text", F.explode("sizes").alias("n")).where(F.col("n") <= F.length("callee_text"))
    grams = cuts.select("callee_text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("callee_text") - F.col("n") + 1), lambda i: F.substring(F.col("callee_text"), i, F.col("n"))))).alias("name"))
    oldest = first_per(calls.where("callee_text is not null").select("callee_text", "from_fqdn", "id"), ["callee_text"], ["id"], fetch).drop("rank")
    hits = grams.join(r, "name").join(oldest, "callee_text")
    seen = first_per(hits, ["fqdn"], ["id"], fetch).drop("rank").where(F.col("from_fqdn").isNotNull() & (F.col("from_fqdn") != F.col("fqdn")))
    fresh = seen.join(known.select("fqdn", "from_fqdn").distinct(), ["fqdn", "from_fqdn"], "left_anti")
    once = fresh.groupBy("fqdn", "from_fqdn").agg(F.min("id").alias("id"))
    return first_per(once, ["fqdn"], ["id"], cap).select("fqdn", "from_fqdn", "id")


def ordered_sites(edges: DataFrame) -> DataFrame:
    """edge_id, ordinal, file, line, col: an edge's sites in order; empty and null lists give no row."""
    s = edges.select("edge_id", F.posexplode(F.array_sort("sites")).alias("pos", "s"))
    return s.select("edge_id", F.col("pos").alias("ordinal"), "s.file", "s.line", "s.col")
