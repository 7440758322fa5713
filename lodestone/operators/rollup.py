"""Rollups of the graph: projects, modules, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import expr


def canonical_projects(projects: DataFrame) -> DataFrame:
    """project_id, canonical_id: projects that share a label stand for the one of the least id."""
    least = projects.groupBy("label").agg(F.min("project_id").alias("canonical_id"))
    return projects.select("project_id", "label").join(least, "label").select("project_id", "canonical_id", "label")


def symbol_projects(symbols: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """fqdn, canonical_id of each symbol whose file belongs to a project."""
    f = files.select(F.col("path").alias("file_path"), "project_id").join(canonical_projects(projects), "project_id")
    return symbols.select("fqdn", "file_path").join(f, "file_path").select("fqdn", "canonical_id").distinct()


def project_edges(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """from_project, to_project, kind, weight between different projects; each edge folds into its pair before the sum."""
    a = homes.select(F.col("fqdn").alias("from_fqdn"), F.col("canonical_id").alias("from_project"))
    b = homes.select(F.col("fqdn").alias("target"), F.col("canonical_id").alias("to_project"))
    e = edges.where("resolved").groupBy("from_fqdn", "target", "kind").agg(F.count("*").alias("n"))
    j = e.join(a, "from_fqdn").join(b, "target").where("from_project <> to_project")
    return j.groupBy("from_project", "to_project", "kind").agg(F.sum("n").alias("weight"))


def representative(symbols: DataFrame) -> DataFrame:
    """module, fqdn: the symbol to open a module with: an entry point, else public, else the shortest path, then the name."""
    rank = F.struct(F.col("entry_point").isNull().alias("ep"), (~F.coalesce(F.col("visibility") == "public", F.lit(False))).alias("vis"), F.size(expr.segments(F.col("fqdn"))).alias("n"), F.col("fqdn"))
    return symbols.where("module is not null").groupBy("module").agg(F.min_by("fqdn", rank).alias("representative"))


def module_rollup(symbols: DataFrame, scope: str, levels: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, homes) below a module path: every symbol at its nearest module at most ``levels`` below the scope.

    nodes: module, depth, symbols; homes: fqdn, module.
    """
    base = len(scope.split("::"))
    inside = symbols.where((F.col("fqdn") == scope) | F.startswith("fqdn", F.lit(scope + "::"))).select("fqdn").distinct()
    mods = symbols.where("kind = 'module'").select(F.col("fqdn").alias("prefix")).distinct()
    ups = inside.select("fqdn", F.explode(expr.prefixes(expr.segments(F.col("fqdn")), "::")).alias("h")).select("fqdn", "h.depth", "h.prefix").where((F.col("depth") >= base) & (F.col("depth") <= base + levels))
    homes = ups.join(mods, "prefix").groupBy("fqdn").agg(F.max_by("prefix", "depth").alias("module"))
    nodes = homes.groupBy("module").agg(F.count("*").alias("symbols")).withColumn("depth", F.size(expr.segments(F.col("module"))) - base)
    return nodes, homes


def scoped_edges(symbols: DataFrame, edges: DataFrame, levels: int = 1) -> DataFrame:
    """scope, from_module, to_module, edge_kind, kind, weight: what joins modules, for every module (or folder of modules) as scope.

    ``parent_child`` leads from a module to those right below it (weight 1, no kind); ``cross`` counts the edges between the
    modules of their ends by kind, without those inside a module and those between a module and its parent.
    """
    # Folders that only hold modules are nodes and scopes too, although no symbol stands for them.
    mods = symbols.where("kind = 'module'").select(F.explode(expr.prefixes(expr.segments(F.col("fqdn")), "::")).alias("h")).select("h.prefix").distinct()
    heads = symbols.select("fqdn").distinct().select("fqdn", F.explode(expr.prefixes(expr.segments(F.col("fqdn")), "::")).alias("h")).select("fqdn", "h.depth", "h.prefix")
    ups = heads.join(mods, "prefix").groupBy("fqdn").agg(F.collect_list(F.struct("depth", "prefix")).alias("m"))
    # A symbol has few modules above it: its home in each scope is picked from its own row.
    near = F.transform("m", lambda a: F.struct(a["prefix"].alias("scope"), F.array_max(F.filter("m", lambda b: (b["depth"] >= a["depth"]) & (b["depth"] <= a["depth"] + levels)))["prefix"].alias("module")))
    homes = ups.select("fqdn", F.explode(near).alias("h")).select("fqdn", "h.scope", "h.module")
    parent = F.regexp_replace("module", "::[^:]*$", "")
    nodes = homes.select("scope", "module").distinct()
    tree = nodes.where(F.col("module") != F.col("scope")).select("scope", parent.alias("from_module"), F.col("module").alias("to_module"))
    tree = tree.join(nodes.withColumnRenamed("module", "from_module"), ["scope", "from_module"], "left_semi")
    tree = tree.select("scope", "from_module", "to_module", F.lit("parent_child").alias("edge_kind"), F.lit(None).cast("string").alias("kind"), F.lit(1).cast("bigint").alias("weight"))
    e = edges.where("resolved").groupBy("from_fqdn", "target", "kind").agg(F.count("*").alias("n"))
    ends = e.join(homes.select(F.col("fqdn").alias("from_fqdn"), "scope", F.col("module").alias("from_module")), "from_fqdn")
    ends = ends.join(homes.select(F.col("fqdn").alias("target"), "scope", F.col("module").alias("to_module")), ["target", "scope"])
    up = lambda c: F.regexp_replace(c, "::[^:]*$", "")
    apart = (F.col("from_module") != F.col("to_module")) & (up("from_module") != F.col("to_module")) & (up("to_module") != F.col("from_module"))
    cross = ends.where(apart).groupBy("scope", "from_module", "to_module", F.lit("cross").alias("edge_kind"), "kind").agg(F.sum("n").alias("weight"))
    return tree.unionByName(cross)


def common_path(rows: DataFrame, by: str, path: str) -> DataFrame:
    """``by``, prefix: the longest folder path that all of a group's paths share. Folds by the least and greatest path: what
    those two share, all in between share, so no group is gathered."""
    g = rows.where(F.col(path).isNotNull()).groupBy(by).agg(F.min(F.split(path, "/")).alias("a"), F.max(F.split(path, "/")).alias("b"))
    n = F.aggregate(F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, x: F.struct((s["n"] + (s["go"] & x).cast("int")).alias("n"), (s["go"] & x).alias("go")), lambda s: s["n"])
    return g.select(by, F.array_join(F.slice("a", 1, F.greatest(n, F.lit(0))), "/").alias("prefix"))


def labels(projects: DataFrame) -> DataFrame:
    """project_id, shown: labels, with the path behind those that several projects share."""
    n = projects.groupBy("label").agg(F.count("*").alias("n"))
    return projects.join(n, "label").select("project_id", F.when(F.col("n") > 1, F.concat(F.col("label"), F.lit(" ("), F.col("rel_path"), F.lit(")"))).otherwise(F.col("label")).alias("shown"))
