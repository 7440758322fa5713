"""Sources: files of a folder tree, manifests, configuration blocks, other indexes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.operators.incremental import ignored

#: Manifests, the kind of project they stand for, the strongest first; and where a CMake project keeps its
#: sources, whose endings tell C++ from C.
MANIFESTS = {"Cargo.toml": "rust", "bun.lockb": "bun", "bun.lock": "bun", "deno.json": "deno", "deno.jsonc": "deno", "package.json": "node", "pyproject.toml": "python", "go.mod": "go", "CMakeLists.txt": "cmake"}
CMAKE_FOLDERS = ("src", "source", "sources", "include", "lib", "tests", "test")
CPP_ENDINGS, C_ENDINGS = ("cpp", "cc", "cxx", "C", "c++", "hpp", "hxx", "h++"), ("c", "h")
#: Blocks of a configuration and the fields they take.
BLOCKS = {"ignore": ("patterns",), "project": ("kind", "path", "paths"), "group": ("members", "projects"), "mcp": ("port",), "viz": ("port",)}


def walk(spark: SparkSession, root: str, layers: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """path (relative), content, content_hash, language, byte_size of the indexable files below ``root``; ignored and
    unknown ones are dropped before their bytes are read (the path predicate reaches the listing)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    f = f.withColumn("path", rel).where(expr.language_of_path(F.col("path")).isNotNull())
    if layers:
        f = f.where(~ignored(F.col("path"), layers))
    text = F.decode("content", "UTF-8")
    return f.select("path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), expr.language_of_path(F.col("path")).alias("language"), F.col("length").alias("byte_size"))


def discover_projects(paths: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """rel_path, kind, label of the folders that hold a manifest, one project per folder, the strongest manifest's kind;
    declared projects replace what was found. Unknown kinds are not kept: they would win longest-prefix joins.

    A rockspec makes a Lua project. A CMake folder counts where C or C++ sources lie below one of its usual folders, and is
    C++ as soon as one of them is.
    """
    if declared is not None and not declared.isEmpty():
        return declared.select("rel_path", "kind", "label")
    folder = F.regexp_replace(F.regexp_replace("path", "[^/]*$", ""), "/$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rank = F.create_map(*[x for i, k in enumerate(MANIFESTS) for x in (F.lit(k), F.lit(i))])[name]
    kind = F.create_map(*[x for k, v in MANIFESTS.items() for x in (F.lit(k), F.lit(v))])[name]
    spec = F.endswith(name, F.lit(".rockspec"))
    found = paths.select(folder.alias("rel_path"), F.when(spec, "lua").otherwise(kind).alias("kind"), F.when(spec, len(MANIFESTS) - 2).otherwise(rank).alias("rank")).where("kind is not null")
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    sources = paths.where(ending.isin(*CPP_ENDINGS, *C_ENDINGS)).select(F.split("path", "/").alias("s"), ending.isin(*CPP_ENDINGS).alias("cpp"))
    # Every folder above a usual one: where the CMake file may lie.
    above = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i).isin(*CMAKE_FOLDERS))
    roots = sources.where(F.size("s") > 1).select(F.explode(above).alias("i"), "s", "cpp").select(F.array_join(F.slice("s", 1, F.col("i") - 1), "/").alias("rel_path"), "cpp").groupBy("rel_path").agg(F.max("cpp").alias("cpp"))
    cmake = found.where("kind = 'cmake'").join(roots, "rel_path").select("rel_path", F.when(F.col("cpp"), "cpp").otherwise("c").alias("kind"), "rank")
    every = found.where("kind <> 'cmake'").unionByName(cmake)
    return every.groupBy("rel_path").agg(F.min_by("kind", F.struct("rank", "kind")).alias("kind")).withColumn("label", F.when(F.col("rel_path") == "", "root").otherwise(F.regexp_extract("rel_path", "([^/]*)$", 1)))


def legacy_config(ignore_text: str) -> str:
    """The configuration text that takes over an old ignore file: its lines in an ``ignore`` block, comments and blanks too."""
    body = "".join(f"  {s}\n" if s.strip() else "\n" for s in ignore_text.rstrip("\n").split("\n"))
    return f"version = 1\n\nignore {{\n{body}}}\n"


def parse_config(text: str, strict: bool = True) -> dict[str, list]:
    """Blocks ``ignore``, ``project "label" "path"``, ``group "name"``, ``mcp`` and ``viz`` of a configuration text.

    ``name [arguments] { line ... }``; lines are patterns, members or ``key = value``; ``#`` and ``//`` open comments. At the
    top only ``version`` may be assigned. Unknown blocks, fields and assignments raise, as an unclosed block does; with
    ``strict`` off unknown blocks are kept under their name.
    """
    out: dict[str, list] = {k: [] for k in BLOCKS}
    clean = re.sub(r"(?m)(?:^|\s)(?:#|//).*$", "", text)
    pos, outside = 0, ""
    for m in re.finditer(r"(\w+)((?:\s+(?:\"[^\"]*\"|[\w./-]+))*)\s*\{", clean):
        if m.start() < pos:
            continue
        end = clean.find("}", m.end())
        if end < 0:
            raise ValueError(f"block {m.group(1)} is not closed")
        # A word at the end of the line above belongs to an assignment, not to the block.
        head = clean[m.start() : m.end()].rsplit("\n", 1)
        kind, rest = re.match(r"\s*(\w+)(.*)", head[-1], re.S).groups() if len(head) > 1 and re.match(r"\s*\w+.*\{", head[-1]) else (m.group(1), m.group(2))
        outside += clean[pos : m.start()] + (head[0] + "\n" if len(head) > 1 and kind != m.group(1) else "")
        if strict and kind not in BLOCKS:
            raise ValueError(f"unknown block {kind}")
        args = [a or b for a, b in re.findall(r"\"([^\"]*)\"|([\w./-]+)", rest.rstrip("{"))]
        lines = [x.strip().strip(",").strip('"') for x in clean[m.end() : end].split("\n") if x.strip()]
        if kind == "ignore":
            out["ignore"] += lines
        else:
            body = dict(re.split(r"\s*=\s*", x, maxsplit=1) for x in lines if "=" in x)
            if strict and (bad := set(body) - set(BLOCKS[kind])):
                raise ValueError(f"unknown field {sorted(bad)[0]} in block {kind}")
            out.setdefault(kind, []).append({"args": args, "lines": [x for x in lines if "=" not in x], **{k: v.strip('"') for k, v in body.items()}})
        pos = end + 1
    for key in re.findall(r"(\w+)\s*=", outside + clean[pos:]):
        if strict and key != "version":
            raise ValueError(f"unknown assignment {key}")
    return out


def config_groups(spark: SparkSession, config: dict[str, list]) -> DataFrame:
    rows = [(g["args"][0] if g["args"] else "", m) for g in config["group"] for m in g["lines"]]
    return spark.createDataFrame(rows, "group_name string, member string")


def import_peer(rows: DataFrame, workspace_id: str) -> DataFrame:
    """Another index's rows under this workspace id; file paths get the peer mark."""
    out = rows.withColumn("workspace_id", F.lit(workspace_id))
    for c in ("file_path", "path", "file"):
        if c in out.columns:
            out = out.withColumn(c, scope_path(F.col(c), workspace_id))
    if "sites" in out.columns:
        out = out.withColumn("sites", F.transform("sites", lambda s: F.struct(scope_path(s["file"], workspace_id).alias("file"), s["line"].alias("line"), s["col"].alias("col"))))
    return out


def scope_path(path, workspace_id: str):
    """``ws:<id>:<path>``; marked paths and null stay."""
    return F.when(F.startswith(path, F.lit("ws:")), path).otherwise(F.concat(F.lit(f"ws:{workspace_id}:"), path))


def external_lookup(requests: DataFrame, externals: DataFrame) -> DataFrame:
    """requests (provider, fqdn) with status resolved, not_found or missing_binary, from a table of externals
    (provider, available, fqdn, file_path). Running package managers is left to whoever fills the table."""
    have = externals.groupBy("provider").agg(F.max("available").alias("available"))
    hit = externals.where("fqdn is not null").select("provider", "fqdn", "file_path")
    j = requests.join(have, "provider", "left").join(hit, ["provider", "fqdn"], "left")
    return j.select("provider", "fqdn", "file_path", F.when(F.col("file_path").isNotNull(), "resolved").when(~F.coalesce("available", F.lit(False)), "missing_binary").otherwise("not_found").alias("status"))
