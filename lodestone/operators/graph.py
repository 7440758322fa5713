"""Bounded traversal of the symbol graph for many focal symbols at once: one join per hop, never per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.expr import clamp
from lodestone.session import cut


def adjacency(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node, other, from_fqdn, to_fqdn, kind, outbound, edge_id: resolved edges from both of their ends."""
    e = edges.where("resolved and from_fqdn is not null")
    if kinds is not None:
        e = e.where(F.col("kind").isin(*kinds))
    ends = F.array(
        F.struct(F.col("from_fqdn").alias("node"), F.col("target").alias("other"), F.lit(True).alias("outbound")),
        F.struct(F.col("target").alias("node"), F.col("from_fqdn").alias("other"), F.lit(False).alias("outbound")),
    )
    return e.select("edge_id", "from_fqdn", F.col("target").alias("to_fqdn"), "kind", F.inline(ends))


def neighbourhood(focals: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int | None = 2, max_nodes: int | None = 500, kinds: list[str] | None = None) -> DataFrame:
    """focal, node, depth, ordinal: what a breadth-first walk from each focal symbol admits.

    Discovery order is that of the one-node-at-a-time walk: nodes of the last hop in their order, for each its outbound
    edges by id and then its inbound ones; at most ``max_nodes`` nodes per focal, the focal one included. A focal name
    that is no symbol gives no row. Each hop is one join of the frontier with the adjacency, folded to one row per
    (focal, node) before it is shuffled again, and is written to the shared folder, so the plan doesn't grow.
    """
    depth, most = clamp(depth, 2, 1, 5), clamp(max_nodes, 500, 1, 5000)
    adj = adjacency(edges, kinds).select("node", "other", "outbound", "edge_id")
    # One hop reads the edges once; only more of them are worth writing the adjacency down.
    adj = cut(adj) if depth > 1 else adj
    known = symbols.select(F.col("fqdn").alias("focal")).distinct()
    seen = cut(focals.select("focal").distinct().join(known, "focal", "left_semi").select("focal", F.col("focal").alias("node"), F.lit(0).alias("depth"), F.lit(1).alias("ordinal")))
    for hop in range(1, depth + 1):
        front = seen.where(F.col("depth") == hop - 1)
        found = front.join(adj, "node").groupBy("focal", F.col("other").alias("node")).agg(F.min(F.struct(F.col("ordinal").alias("o"), (~F.col("outbound")).alias("inward"), F.col("edge_id").alias("e"))).alias("at"))
        fresh = found.join(seen.select("focal", "node"), ["focal", "node"], "left_anti")
        base = seen.groupBy("focal").agg(F.count("*").alias("have"))
        ranked = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("focal").orderBy("at", "node"))).where(F.col("rank") <= most)
        new = ranked.join(base, "focal").withColumn("ordinal", (F.col("have") + F.col("rank")).cast("int")).where(F.col("ordinal") <= most)
        seen = cut(seen.unionByName(new.select("focal", "node", F.lit(hop).alias("depth"), "ordinal")))
    return seen


def dispatch(requests: DataFrame, edges: DataFrame, symbols: DataFrame, depth: int | None = 2, max_nodes: int | None = 500) -> DataFrame:
    """focal, known, nodes of each request (focal): the size of its neighbourhood; a name that is no symbol is echoed with
    none. Repeated requests are one, a null one is dropped."""
    asked = requests.where("focal is not null").select("focal").distinct()
    n = neighbourhood(asked, edges, symbols, depth, max_nodes).groupBy("focal").agg(F.count("*").alias("nodes"))
    return asked.join(n, "focal", "left").select("focal", F.col("nodes").isNotNull().alias("known"), F.coalesce("nodes", F.lit(0).cast("bigint")).alias("nodes"))


def edges_within(nodes: DataFrame, edges: DataFrame, kinds: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """focal, from_fqdn, to_fqdn, kind, outbound: edges with both ends admitted and one end expanded (nearer than the last
    hop), once per (from, to, kind); ``outbound`` as first discovered."""
    adj = adjacency(edges, kinds)
    near = nodes if depth is None else nodes.where(F.col("depth") < depth)
    e = near.select("focal", "node", "depth", "ordinal").join(adj, "node")
    first = e.groupBy("focal", "from_fqdn", "to_fqdn", "kind").agg(F.min_by("outbound", F.struct("depth", "ordinal", (~F.col("outbound")).alias("inward"), "edge_id")).alias("outbound"))
    a = nodes.select("focal", F.col("node").alias("from_fqdn"))
    b = nodes.select("focal", F.col("node").alias("to_fqdn"))
    return first.join(a, ["focal", "from_fqdn"], "left_semi").join(b, ["focal", "to_fqdn"], "left_semi")


def bounded(symbols: DataFrame, edges: DataFrame, n: int = 500, kinds: list[str] | None = None, include_external: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first ``n`` symbols by path and the subgraph they induce, no edge dangling."""
    s = symbols if include_external else symbols.where("not coalesce(is_external, false)")
    nodes = s.select("fqdn").distinct().orderBy("fqdn").limit(n)
    e = edges.where("resolved") if kinds is None else edges.where(F.col("resolved") & F.col("kind").isin(*kinds))
    e = e.select("from_fqdn", F.col("target").alias("to_fqdn"), "kind").distinct()
    e = e.join(nodes.select(F.col("fqdn").alias("from_fqdn")), "from_fqdn", "left_semi").join(nodes.select(F.col("fqdn").alias("to_fqdn")), "to_fqdn", "left_semi")
    return nodes, e


def undirected_depth(shown: DataFrame, most: int = 5) -> DataFrame:
    """focal, node, depth: hops over the shown edges, whatever their direction; ends that aren't reached are left out."""
    both = cut(shown.select("focal", F.col("from_fqdn").alias("node"), F.col("to_fqdn").alias("other")).unionByName(shown.select("focal", F.col("to_fqdn").alias("node"), F.col("from_fqdn").alias("other"))).distinct())
    seen = shown.select("focal").distinct().select("focal", F.col("focal").alias("node"), F.lit(0).alias("depth"))
    for hop in range(1, most + 1):
        step = seen.where(F.col("depth") == hop - 1).join(both, ["focal", "node"]).select("focal", F.col("other").alias("node")).distinct()
        seen = cut(seen.unionByName(step.join(seen.select("focal", "node"), ["focal", "node"], "left_anti").withColumn("depth", F.lit(hop))))
    return seen
