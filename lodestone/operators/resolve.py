"""Resolution of unresolved references: pure functions from symbols and edges to hits, one join per rule.

Rules keep the first hit in a fixed order. Keys are compared exactly, and a rule that asks for a unique candidate counts
candidates instead of taking any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.session import cut

BUILTIN = "<builtin>::"


def open_calls(edges: DataFrame) -> DataFrame:
    """edge_id, workspace_id, from_fqdn, kind, method, receiver_type of edges whose target is text only."""
    return edges.where("not resolved and to_unresolved is not null").select("edge_id", "workspace_id", "from_fqdn", "kind", F.col("to_unresolved").alias("method"), "receiver_type")


def by_receiver(open_: DataFrame, symbols: DataFrame, language: str = "rust") -> DataFrame:
    """edge_id, hit, route: CALLS edges with a receiver type. Exact ``type::method``; else, for a bare type name, the one
    workspace symbol that ends in it (two or more give none); else the built-in type's method."""
    c = open_.where("kind = 'CALLS' and receiver_type is not null and length(method) > 0").select("edge_id", F.concat_ws("::", "receiver_type", "method").alias("key"), (~F.contains("receiver_type", F.lit("::"))).alias("bare"))
    names = symbols.select("fqdn").distinct()
    exact = names.select(F.col("fqdn").alias("key"), F.col("fqdn").alias("exact"))
    seg = expr.segments(F.col("fqdn"))
    tails = (
        names.where(~F.startswith("fqdn", F.lit(BUILTIN)) & (F.size(seg) >= 3))
        .select("fqdn", F.array_join(F.slice(seg, -2, 2), "::").alias("key"))
        .groupBy("key").agg(F.min("fqdn").alias("tail"), F.count("*").alias("n")).where("n = 1").drop("n")
    )
    j = c.join(exact, "key", "left").join(tails, "key", "left")
    b = names.where(F.startswith("fqdn", F.lit(BUILTIN))).select(F.col("fqdn").alias("builtin"))
    j = j.withColumn("bkey", F.concat(F.lit(f"{BUILTIN}{language}::"), "key")).join(b, F.col("bkey") == F.col("builtin"), "left")
    tail = F.when(F.col("bare"), F.col("tail"))
    route = F.when(F.col("exact").isNotNull(), "receiver_exact").when(tail.isNotNull(), "receiver_suffix").when(F.col("builtin").isNotNull(), "receiver_builtin")
    return j.select("edge_id", F.coalesce("exact", tail, "builtin").alias("hit"), route.alias("route")).where("hit is not null")


def by_trait(open_: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, hit, route: the method of the alphabetically first trait that the receiver implements and that has it.
    Implementors are matched by their whole path or their last segment; built-in implementors don't count."""
    impl = edges.where("kind = 'IMPLEMENTS' and target is not null").where(~F.startswith("from_fqdn", F.lit(BUILTIN)))
    ends = impl.select(F.explode(F.array_distinct(F.array("from_fqdn", expr.last_segment(F.col("from_fqdn"))))).alias("receiver_type"), F.col("target").alias("trait")).distinct()
    c = open_.where("kind = 'CALLS' and receiver_type is not null").join(ends, "receiver_type").withColumn("fqdn", F.concat_ws("::", "trait", "method"))
    return c.join(symbols.select("fqdn").distinct(), "fqdn").groupBy("edge_id").agg(F.min_by("fqdn", "trait").alias("hit")).withColumn("route", F.lit("trait_dispatch"))


def by_builtin_trait(open_: DataFrame, symbols: DataFrame) -> DataFrame:
    """edge_id, hit, route: the least built-in symbol of the method's name that is flagged as a trait method."""
    t = symbols.where(F.startswith("fqdn", F.lit(BUILTIN)) & F.array_contains("flags", "trait_method")).groupBy(F.col("name").alias("method")).agg(F.min("fqdn").alias("hit"))
    return open_.where("kind = 'CALLS'").join(t, "method").select("edge_id", "hit", F.lit("builtin_trait").alias("route"))


def exports(symbols: DataFrame) -> DataFrame:
    """workspace_id, module, symbol, fqdn: what a module offers at its root scope."""
    return symbols.where("module is not null and coalesce(visibility, 'public') <> 'private'").select("workspace_id", "module", F.col("name").alias("symbol"), "fqdn")


def by_suffix_chain(open_: DataFrame, offers: DataFrame) -> DataFrame:
    """edge_id, hit, route, provider: paths split into module and symbol, the longest module first; own workspace before
    peers, then by workspace id; the first segment also with ``-`` for ``_``. What follows the symbol is appended again.

    All splits are exploded and joined by equality; ``min_by`` keeps the best.
    """
    p = open_.where(F.contains("method", F.lit("::"))).select("edge_id", "workspace_id", expr.segments(F.col("method")).alias("s"))
    splits = p.select("edge_id", F.col("workspace_id").alias("own"), "s", F.explode(F.sequence(F.size("s") - 1, F.lit(1), F.lit(-1))).alias("n"))
    head = F.array_join(F.slice("s", 1, F.col("n")), "::")
    dashed = F.array_join(F.concat(F.array(F.regexp_replace(F.element_at("s", 1), "_", "-")), F.slice("s", 2, F.col("n") - 1)), "::")
    keyed = splits.select("edge_id", "own", "n", F.element_at("s", F.col("n") + 1).alias("symbol"), F.array_join(F.slice("s", F.col("n") + 2, F.size("s")), "::").alias("tail"), F.posexplode(F.array_distinct(F.array(head, dashed))).alias("alt", "module"))
    hit = keyed.join(offers, ["module", "symbol"])
    order = F.struct((-F.col("n")).alias("n"), "alt", (F.col("workspace_id") != F.col("own")).alias("peer"), "workspace_id", "fqdn")
    best = hit.groupBy("edge_id").agg(F.min_by(F.struct(F.when(F.col("tail") == "", F.col("fqdn")).otherwise(F.concat_ws("::", "fqdn", "tail")).alias("hit"), "workspace_id"), order).alias("b"))
    return best.select("edge_id", "b.hit", F.lit("suffix_chain").alias("route"), F.col("b.workspace_id").alias("provider"))


def sweep(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """edge_id, hit, route of each unresolved edge that some rule resolves: receiver, trait, built-in trait, suffix chain.
    An edge that already names a live symbol by text comes first (``exact_text``)."""
    o = open_calls(edges)
    exact = o.join(symbols.select("workspace_id", F.col("fqdn").alias("method")), ["workspace_id", "method"], "left_semi").select("edge_id", F.col("method").alias("hit"), F.lit("exact_text").alias("route"))
    rules = [exact, by_receiver(o, symbols), by_trait(o, symbols, edges), by_builtin_trait(o, symbols), by_suffix_chain(o, exports(symbols)).drop("provider")]
    every = None
    for i, r in enumerate(rules):
        r = r.withColumn("order", F.lit(i))
        every = r if every is None else every.unionByName(r)
    return every.groupBy("edge_id").agg(F.min_by(F.struct("hit", "route"), F.struct("order", "hit")).alias("b")).select("edge_id", "b.*")


def report(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """route, edges: how many unresolved edges each rule resolved, and ``unresolved`` for the rest."""
    j = open_calls(edges).select("edge_id").join(sweep(symbols, edges), "edge_id", "left")
    return j.groupBy(F.coalesce("route", F.lit("unresolved")).alias("route")).agg(F.count("*").alias("edges"))


def declaration_twins(symbols: DataFrame) -> DataFrame:
    """workspace_id, decl_fqdn, def_fqdn, outcome: C declarations in headers beside their definitions by name; exactly one
    definition joins, none leaves the declaration an orphan, several are ambiguous. Definitions fold to a count first."""
    c = symbols.where("kind = 'callable'")
    decl = c.where(F.endswith("file_path", F.lit(".h"))).select("workspace_id", "name", F.col("fqdn").alias("decl_fqdn"))
    defs = c.where(F.endswith("file_path", F.lit(".c"))).groupBy("workspace_id", "name").agg(F.count("*").alias("n"), F.min("fqdn").alias("def_fqdn"))
    j = decl.join(defs, ["workspace_id", "name"], "left")
    out = F.when(F.col("n") == 1, "joined").when(F.col("n") > 1, "ambiguous").otherwise("orphan")
    return j.select("workspace_id", "decl_fqdn", F.when(F.col("n") == 1, F.col("def_fqdn")).alias("def_fqdn"), out.alias("outcome"))


def foreign_links(bindings: DataFrame, existing: DataFrame) -> DataFrame:
    """workspace_id, from_fqdn, to_fqdn, attribute: importers with the one exporter of their (workspace, abi, name); not to
    themselves, not twice, none where several export. bindings: workspace_id, fqdn, abi, direction, abi_name."""
    b = bindings.where("abi is not null and abi_name is not null")
    exp = b.where("direction = 'export'").groupBy("workspace_id", "abi", "abi_name").agg(F.countDistinct("fqdn").alias("n"), F.min("fqdn").alias("to_fqdn")).where("n = 1").drop("n")
    imp = b.where("direction = 'import'").select("workspace_id", "abi", "abi_name", F.col("fqdn").alias("from_fqdn")).distinct()
    j = imp.join(exp, ["workspace_id", "abi", "abi_name"]).where("from_fqdn <> to_fqdn").select("workspace_id", "from_fqdn", "to_fqdn", F.concat(F.lit("ffi:"), "abi").alias("attribute")).distinct()
    return j.join(existing.where("kind = 'IMPORTS'").select("workspace_id", "from_fqdn", "to_fqdn").distinct(), ["workspace_id", "from_fqdn", "to_fqdn"], "left_anti")


def local_names(uses: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """use_id, target: names looked up through the scope chain, innermost scope first, in one scope the latest binding.

    scopes: module, scope_idx, parent_idx; bindings: module, scope_idx, ordinal, name, target; uses: use_id, module,
    scope_idx, name. Chains are climbed one parent per round by a join, at most 32 deep; each round is written to the shared
    folder, so none is worked out again.
    """
    at = uses.select("use_id", "module", "name", F.col("scope_idx").alias("cur"), F.lit(0).alias("up"))
    chain = at
    step = scopes.select("module", F.col("scope_idx").alias("cur"), "parent_idx")
    for _ in range(32):
        at = at.join(step, ["module", "cur"]).where("parent_idx is not null and parent_idx <> cur").select("use_id", "module", "name", F.col("parent_idx").alias("cur"), (F.col("up") + 1).alias("up"))
        at = cut(at)
        if at.isEmpty():
            break
        chain = chain.unionByName(at)
    hit = chain.join(bindings.withColumnRenamed("scope_idx", "cur"), ["module", "cur", "name"])
    return hit.groupBy("use_id").agg(F.min_by("target", F.struct("up", (-F.col("ordinal")).alias("late"))).alias("target"))


def builtin_tier(edges: DataFrame, builtins: DataFrame) -> DataFrame:
    """edges (edge_id, language, name) by the built-in table (language, name, tier, synthetic_fqdn): ``drop`` removes the
    edge, ``attribute`` turns it into a flag on its source, ``edge`` points it at the synthetic target."""
    j = edges.join(builtins.select("language", "name", "tier", "synthetic_fqdn"), ["language", "name"], "left")
    return j.select(*edges.columns, F.coalesce("tier", F.lit("none")).alias("tier"), F.when(F.col("tier") == "edge", F.col("synthetic_fqdn")).alias("to_fqdn"), F.when(F.col("tier") == "attribute", F.concat(F.lit("builtin-"), F.lower("name"))).alias("flag"))
