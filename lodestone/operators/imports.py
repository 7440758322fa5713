"""Import specifiers of scripts resolved to files: relative paths, then the paths of tsconfig files, then node_modules.

Every place a specifier may mean is a candidate row, and candidates meet the files by one equality join; the best rank wins.
No file system is walked.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import expr

#: What may follow a specifier, in the order it is tried.
SUFFIXES = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".vue", ".svelte", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
#: Comments of a JSON text, and strings, which hide them; commas before a closing mark.
_JSONC = re.compile(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_TRAILING = re.compile(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", re.S)


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    return _TRAILING.sub(lambda m: m.group(1) or "", _JSONC.sub(lambda m: m.group(1) or "", text))


def path_rules(text: str | None) -> list[tuple[int, str, str, str]]:
    """(ordinal, what the specifier begins with, what it ends with, target) of a tsconfig text's ``paths``, targets below its
    base folder; none where the text isn't JSON or names no paths. A pattern without a star has a null end."""
    try:
        o = json.loads(strip_jsonc(text or "")).get("compilerOptions") or {}
    except (ValueError, AttributeError):
        return []
    base, paths = o.get("baseUrl"), o.get("paths")
    out = []
    for pattern, targets in paths.items() if isinstance(paths, dict) else ():
        head, star, tail = pattern.partition("*")
        for t in targets if isinstance(targets, list) else ():
            if isinstance(t, str):
                out.append((len(out), head, tail if star else None, f"{base or '.'}/{t}"))
    return out


_RULE = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("target", T.StringType())]))


@F.pandas_udf(_RULE)
def path_rules_udf(text: pd.Series) -> pd.Series:
    return text.map(path_rules)


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` steps and doubled slashes; steps above the root are dropped."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def folder(path: Column) -> Column:
    """The folder a path lies in; empty at the root."""
    return F.regexp_replace(path, r"(?:^|/)[^/]*$", "")


def _ancestors(path: Column) -> Column:
    """(depth, prefix) of the root and every folder above a path."""
    return F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("prefix"))), expr.prefixes(F.split(folder(path), "/"), "/"))


def resolve_imports(imports: DataFrame, files: DataFrame, configs: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """imports (file, spec) with ``resolved`` (a path of ``files``) and ``route``: relative, paths or package; both null where
    nothing fits (the specifier stays text).

    configs: path, content of tsconfig files; the nearest one above a file holds for it, its rules in their order.
    packages: path (``.../node_modules/<name>/package.json``), entry. The nearest node_modules folder wins.
    """
    i = imports.where("file is not null and spec is not null").select("file", "spec").distinct()
    rel = i.where(F.startswith("spec", F.lit("."))).select("file", "spec", F.lit("relative").alias("route"), F.lit(0).alias("rank"), F.concat_ws("/", folder(F.col("file")), "spec").alias("at"))
    cand = rel
    bare = i.where(~F.startswith("spec", F.lit(".")))
    above = bare.select("file", "spec", F.explode(_ancestors(F.col("file"))).alias("h")).select("file", "spec", "h.depth", F.col("h.prefix").alias("dir"))
    if configs is not None:
        # A folder has one configuration; the nearest with any counts, so the depth is settled before the rules meet the specifier.
        c = configs.select(folder(F.col("path")).alias("dir"), path_rules_udf("content").alias("rules"))
        near = above.join(c.select("dir"), "dir").groupBy("file", "spec").agg(F.max_by("dir", "depth").alias("dir"))
        r = near.join(c.select("dir", F.inline("rules")), "dir")
        fits = F.when(F.col("tail").isNull(), F.col("spec") == F.col("head")).otherwise(F.startswith("spec", F.col("head")) & F.endswith("spec", F.col("tail")) & (F.length("spec") >= F.length("head") + F.length("tail")))
        part = F.expr("substring(spec, length(head) + 1, length(spec) - length(head) - length(coalesce(tail, '')))")
        to = F.when(F.col("tail").isNull(), F.col("target")).otherwise(F.replace("target", F.lit("*"), part))
        cand = cand.unionByName(r.where(fits).select("file", "spec", F.lit("paths").alias("route"), (1000 + F.col("ordinal")).alias("rank"), F.concat_ws("/", "dir", to).alias("at")))
    if packages is not None:
        name = F.when(F.startswith("spec", F.lit("@")), F.substring_index("spec", "/", 2)).otherwise(F.substring_index("spec", "/", 1))
        p = packages.select(folder(F.col("path")).alias("root"), "entry")
        a = above.withColumn("name", name).withColumn("root", F.concat_ws("/", F.when(F.col("dir") != "", F.col("dir")), F.lit("node_modules"), "name"))
        inner = F.expr("substring(spec, length(name) + 2)")
        hit = a.join(p, "root").select("file", "spec", F.lit("package").alias("route"), (1_000_000 - F.col("depth")).alias("rank"), F.concat_ws("/", "root", F.when(F.col("spec") == F.col("name"), F.coalesce("entry", F.lit("index"))).otherwise(inner)).alias("at"))
        cand = cand.unionByName(hit)
    endings = F.posexplode(F.array(*[F.lit(x) for x in SUFFIXES])).alias("n", "ending")
    tried = cand.withColumn("at", normal_path(F.col("at"))).select("file", "spec", "route", "rank", "at", endings).select("file", "spec", "route", "rank", "n", F.concat("at", "ending").alias("path"))
    found = tried.join(files.select("path").distinct(), "path").groupBy("file", "spec").agg(F.min_by(F.struct("path", "route"), F.struct("rank", "n")).alias("b"))
    return i.join(found, ["file", "spec"], "left").select("file", "spec", F.col("b.path").alias("resolved"), F.col("b.route").alias("route"))
