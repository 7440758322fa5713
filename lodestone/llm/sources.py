"""Which paths hold hand-written source of their own project, and which are generated, minified, vendored or data.

Signals per version of a file: its place and name, the notice it opens with, layout statistics (longest and mean line,
white space, letters and digits, numeric literals, encoded runs, serially numbered function names) with thresholds per
language, ``is_external``, and what share of the path's symbols is external. A last step finds copies without a notice:
files whose code, without comments and white space, equals that of a file known to be foreign.

Defined cases: a null content leaves the path, the flags and the symbols to decide; an empty text is hand-written; a null
``is_external`` proves nothing, as does false; one external symbol alone proves nothing. Rows with a null path are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.heavy import skew_safe_semi
from lodestone.session import ship, spread, stored

#: Most rows of the project and workspace tables that are sent to the executors (they name projects, not files).
MAX_PROJECTS = 20_000

#: Folders of tools and of foreign code, whole path segments; names that build steps give to their output.
FOREIGN_DIRS = frozenset("vendor vendors vendored thirdparty third_party third-party 3rdparty node_modules bower_components jspm_packages external externals extern upstream deps site-packages .cargo .luarocks .rustup .store .yarn .pnpm Pods Carthage Godeps".split())
TOOL_DIRS = frozenset("generated __generated__ _generated autogen autogenerated dist .next .nuxt .svelte-kit __pycache__ moc gen-src codegen-out".split())
_TOOL_PAIRS = re.compile(r"(?:^|/)(?:target/(?:debug|release)|build/(?:out|gen|generated|autogen)|out/(?:gen|release|debug))/")
_TOOL_NAME = re.compile(r"(?:[._-](?:pb|gen|g|generated|designer|min|bundle|chunk|bundled|umd\.min|prod)|_pb2|_pb2_grpc|[._-]autogen)\.[A-Za-z]+$|\.(?:d\.ts\.map|js\.map|lock)$", re.I)
_DATA_DIR = re.compile(r"(?:^|/)(?:data|datasets|fixtures/blobs|blobs)/")

#: What notices of tools and of foreign authors say, in the languages met.
GENERATED = re.compile(
    r"auto-?\s?generated|machine[- ](?:written|generated|made)|\bcode generated\b|\bgenerated (?:by|from|on|with|using|file|code)\b|<auto-generated>|"
    r"\b(?:was|is) (?:automatically )?(?:produced|generated|created) (?:by|from|with)\b|changes (?:will|would) be (?:lost|overwritten)|do not (?:edit|modify|change|touch)|don't (?:edit|modify)|"
    r"edit the (?:schema|template|source|grammar) instead|@generated\b|erzeugt (?:von|durch|mit|aus)|nicht (?:bearbeiten|ändern)|automatisch (?:erzeugt|generiert)|"
    r"généré (?:par|à partir)|ne pas (?:modifier|éditer)|généré automatiquement|generado (?:por|desde|a partir)|no (?:editar|modificar)|gegenereerd (?:door|uit)|niet (?:bewerken|wijzigen)",
    re.I,
)
FOREIGN = re.compile(
    r"\b(?:imported|vendored|copied|taken|ported|adapted|borrowed|derived) (?:verbatim )?from\s+(?P<a>[\w.@/-]+)|(?P<b>[\w.@/-]+),? upstream (?:commit|revision|version)|"
    r"provided (?:\"|')?as[- ]is|all rights reserved|(?:übernommen|kopiert) (?:aus|von)\s+(?P<c>[\w.@/-]+)|copié depuis\s+(?P<d>[\w.@/-]+)|copiado de\s+(?P<e>[\w.@/-]+)",
    re.I,
)
_AUTHORS = re.compile(r"copyright\s+(?:\(c\)|©)?\s*(?:\d{4}(?:\s*[-,]\s*\d{4})*,?\s*)?(?:by\s+)?(?:the\s+)?([\w.@/-]+)\s+(?:authors|contributors|developers|project|team|foundation)", re.I)
_PART = re.compile(r"\bpart of (?:the )?([\w.@/-]+)", re.I)

_LEAD = re.compile(r"﻿?(?:#![^\n]*\n)?(?:\s*(?:/\*.*?\*/|//[^\n]*(?:\n|$)|--\[(=*)\[.*?\]\1\]|--[^\n]*(?:\n|$)|<!--.*?-->))+", re.S)
_COMMENTS = re.compile(r"/\*.*?\*/|//[^\n]*|--\[\[.*?\]\]|--[^\n]*|<!--.*?-->", re.S)
_BLANKS = re.compile(r"\s+")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*)\b")
_RUN = re.compile(r"[A-Za-z0-9+/=_%\\-]{40,}")
_QUOTED = re.compile(r"([\"'`])((?:[A-Za-z0-9+/=]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}){16,})\1")
_FUNC = re.compile(r"(?:\bfn|\bfunction|\bfunc|\bdef)\s+(?:[\w.:]+[.:])?(\w+)\s*[(<]|^\s*(?:(?:public|private|protected|static|async|inline|const|unsigned|export|void|int|bool|char|size_t|uint32_t)\s+)+\**(\w+)\s*\(", re.M)
_NOT_ALNUM = re.compile(r"[\W_]+")
_GAP = re.compile(r"\n[ \t]*\n")
_QUOTE = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
_SERIAL = re.compile(r"^\w*?[a-zA-Z]_?(\d+)$")

class Layout(NamedTuple):
    """What hand-written code of a language looks like: longest line; mean line; least share of white space; least and greatest
    share of letters and digits among its ink (minified code lies below, encoded data above); greatest share of ink in numeric
    literals and in encoded runs. Whatever says minified by white space or letters needs a line beyond the longest as well."""

    longest: int
    mean: int
    white: float
    dense: float
    wordy: float
    numeric: float
    encoded: float


#: Thresholds per language. Scripts are the ones that get minified, so their lines are held to be short; components carry
#: long attribute lines; register tables and shader constants make C and Lua more numeric than the others.
LAYOUT = {
    "javascript": Layout(500, 160, 0.060, 0.71, 0.955, 0.35, 0.40),
    "typescript": Layout(500, 160, 0.060, 0.71, 0.955, 0.35, 0.40),
    "css": Layout(500, 160, 0.060, 0.66, 0.970, 0.45, 0.40),
    "rust": Layout(700, 200, 0.050, 0.68, 0.960, 0.35, 0.40),
    "c": Layout(700, 200, 0.050, 0.66, 0.960, 0.40, 0.40),
    "lua": Layout(700, 200, 0.050, 0.70, 0.970, 0.40, 0.40),
    "vue": Layout(900, 220, 0.055, 0.66, 0.960, 0.35, 0.40),
    "svelte": Layout(900, 220, 0.055, 0.66, 0.960, 0.35, 0.40),
}
LAYOUT_ELSE = Layout(1000, 250, 0.05, 0.64, 0.970, 0.40, 0.40)
SERIAL, REPEATED = 0.6, 0.7
#: Endings of the languages that have thresholds of their own.
BY_ENDING = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "c": "c", "h": "c", "lua": "lua", "vue": "vue", "svelte": "svelte", "css": "css"}
#: Least size of a block of code that tells a copy, and the share of a file's blocks that makes it one.
BLOCK, COPIED = 80, 0.5
#: Least code of a file without such blocks that is compared as a whole.
WHOLE = 24


def own_project(path: str, roots: list[tuple[str, str]]) -> str | None:
    """Label of the project whose root is the longest prefix of the path."""
    for root, label in roots:
        if path == root or path.startswith(root + "/"):
            return label
    return None


def place(path: str) -> tuple[bool, bool, bool]:
    """(foreign, tool output, data folder) by folders and name; whole segments only."""
    rel = path.replace("\\", "/").split(":", 2)[-1] if path.startswith("ws:") else path.replace("\\", "/")
    segs = rel.split("/")
    return (
        any(s in FOREIGN_DIRS for s in segs[:-1]),
        any(s in TOOL_DIRS for s in segs[:-1]) or bool(_TOOL_PAIRS.search(rel)) or bool(_TOOL_NAME.search(segs[-1])),
        bool(_DATA_DIR.search(rel)),
    )


def notice(text: str, own: str | None, labels: frozenset[str]) -> tuple[bool, bool]:
    """(generated, foreign) by the comments that open a text. A notice of the own project is none."""
    m = _LEAD.match(text)
    if not m:
        return False, False
    head = m.group(0)
    generated = bool(GENERATED.search(head))
    named = [g for m in FOREIGN.finditer(head) for g in m.groupdict().values() if g]
    named += _AUTHORS.findall(head) + _PART.findall(head)
    mine = {x.lower() for x in ([own] if own else labels)}
    foreign = any(x.strip(".,").lower() not in mine for x in named) if named else bool(FOREIGN.search(head))
    return generated, foreign


def layout(text: str, language: str) -> dict[str, float]:
    """Layout statistics of a whole text."""
    lines = [s for s in text.splitlines() if s.strip()]
    ink = len(_BLANKS.sub("", text)) or 1
    names = [a or b for a, b in _FUNC.findall(text)]
    serial = [int(m.group(1)) for n in names if (m := _SERIAL.match(n))]
    literals = len(_NUMBER.findall(text)) + len(_QUOTE.findall(text))
    steps = sum(b - a == 1 for a, b in zip(serial, serial[1:]))
    encoded = max(sum(len(x) for x in _RUN.findall(text) if any(c.isdigit() for c in x) and any(c.isupper() for c in x)), sum(len(x) for _, x in _QUOTED.findall(text)))
    return {
        "longest": max(map(len, lines), default=0), "mean": sum(map(len, lines)) / max(1, len(lines)), "lines": len(lines),
        "white": 1 - ink / max(1, len(text)), "alnum": len(_NOT_ALNUM.sub("", text)) / ink,
        "numeric": sum(map(len, _NUMBER.findall(text))) / ink, "encoded": encoded / ink,
        "repeated": Counter(_NUMBER.sub("0", _QUOTE.sub("''", x.strip())) for x in lines).most_common(1)[0][1] / len(lines) if len(lines) >= 8 and literals > len(lines) else 0.0,
        "serial": (steps + 1) / len(names) if steps >= 2 else 0.0,
    }


def verdict(stats: dict[str, float], language: str) -> tuple[bool, bool, bool]:
    """(minified, data, numbered like a tool's output) by layout."""
    t = LAYOUT.get(language, LAYOUT_ELSE)
    long = stats["longest"] > t.longest
    minified = long and (stats["mean"] > t.mean or stats["white"] < t.white or stats["alnum"] < t.dense) or stats["mean"] > 2 * t.mean
    data = stats["numeric"] > t.numeric or stats["encoded"] > t.encoded or stats["repeated"] > REPEATED or long and stats["alnum"] > t.wordy
    return minified and not data, data, stats["serial"] >= SERIAL


def blocks(text: str) -> list[int]:
    """64-bit hashes of the blocks of code between blank lines, without comments and white space; short ones, which files
    share by chance, are left out. A file of short blocks only has one hash, that of all its code, if that isn't tiny."""
    m = _LEAD.match(text)
    code = _COMMENTS.sub("", text[m.end() :] if m else text).replace("\r\n", "\n").replace("\r", "\n")
    flat = [_BLANKS.sub("", x) for x in _GAP.split(code)]
    if all(len(x) < BLOCK for x in flat):
        flat = ["whole:" + x for x in ["".join(flat)] if len(x) >= WHOLE]
        return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in flat]
    return sorted({xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in flat if len(x) >= BLOCK})


def project_roots(projects: DataFrame, workspaces: DataFrame) -> list[tuple[str, str]]:
    """(path prefix as files spell it, label), longest first. Both tables list projects and workspaces, not files; their
    size is checked."""
    p = projects.where("root_path is not null").select("root_path", "label").limit(MAX_PROJECTS + 1).collect()
    w = workspaces.where("root_path is not null").select("workspace_id", "root_path").limit(MAX_PROJECTS + 1).collect()
    if max(len(p), len(w)) > MAX_PROJECTS:
        raise ValueError(f"more than {MAX_PROJECTS} projects or workspaces")
    out = []
    for r in p:
        best = max((x for x in w if r.root_path == x.root_path or r.root_path.startswith(x.root_path + "/")), key=lambda x: len(x.root_path), default=None)
        if best:
            rel = r.root_path[len(best.root_path) + 1 :]
            out.append((rel if best.workspace_id == "primary" else f"ws:{best.workspace_id}:{rel}", r.label))
    return sorted(out, key=lambda x: -len(x[0]))


_SIGNALS = "path string, generated boolean, minified boolean, data boolean, foreign boolean, blocks array<bigint>"


def signals(files: DataFrame, projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """One row per stored version: what path, notice, flag and layout say. Narrow; contents are never shuffled."""
    spark = ship(files.sparkSession)
    roots = spark.sparkContext.broadcast(project_roots(projects, workspaces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = frozenset(x for _, x in roots.value)
        for b in batches:
            rows = []
            for path, text, lang, ext in zip(b["path"], b["content"], b["language"], b["is_external"]):
                foreign, tool, data_dir = place(path)
                external = ext is not None and ext is not pd.NA and ext == True  # noqa: E712
                if text is None:
                    rows.append((path, tool, False, data_dir, foreign or external, []))
                    continue
                gen, other = notice(text, own_project(path, roots.value), labels)
                language = (lang or "").strip().lower()
                language = language if language in LAYOUT else BY_ENDING.get(path.rsplit(".", 1)[-1].lower(), language)
                minified, data, serial = verdict(layout(text, language), language)
                rows.append((path, tool or gen or serial, minified, data, foreign or other or external, blocks(text)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SIGNALS.split(", ")])

    d = spread(files.where("path is not null").select("path", "content", "language", "is_external"), "path")
    return d.mapInPandas(run, _SIGNALS)


def external_paths(symbols: DataFrame, least: int = 2, share: float = 0.3) -> DataFrame:
    """Paths of which at least ``least`` symbol rows and ``share`` of them are external or come from outside."""
    out = F.coalesce("is_external", F.lit(False)) | (F.coalesce("source_origin", F.lit("workspace")) != "workspace")
    return (
        symbols.where("file_path is not null").groupBy(F.col("file_path").alias("path"))
        .agg(F.count("*").alias("n"), F.sum(out.cast("int")).alias("k"))
        .where((F.col("k") >= least) & (F.col("k") >= F.lit(share) * F.col("n"))).select("path")
    )


def not_handwritten(files: DataFrame, symbols: DataFrame, projects: DataFrame, workspaces: DataFrame) -> DataFrame:
    """path, generated, minified, data, foreign, copied of each path that isn't hand-written source of its own project.

    A copy has a version of which at least COPIED of the blocks occur in files known to be foreign. Block hashes (never
    texts) are joined, hot ones salted, so that a block found in a third of all files doesn't meet in one task. Everything
    else is joined by path with what is grouped by path already, so these joins ask for a merge: nothing is broadcast.
    """
    sig = stored(signals(files, projects, workspaces), "signals")
    ext = external_paths(symbols).withColumn("ext", F.lit(True))
    flags = sig.groupBy("path").agg(*[F.max(c).alias(c) for c in ("generated", "minified", "data", "foreign")]).join(ext.hint("merge"), "path", "left")
    flags = flags.withColumn("foreign", F.col("foreign") | F.col("ext").isNotNull()).drop("ext")
    versions = sig.where("size(blocks) > 0").select("path", F.xxhash64("blocks").alias("version"), "blocks").dropDuplicates(["path", "version"])
    known = versions.join(flags.select("path", "foreign").hint("merge"), "path")
    origin = known.where("foreign").select(F.explode("blocks").alias("block")).distinct()
    own = known.where("not foreign").select("path", "version", F.size("blocks").alias("all"), F.explode("blocks").alias("block"))
    hits = skew_safe_semi(own, origin, ["block"], spread=F.col("path"))
    copies = hits.groupBy("path", "version").agg(F.count("*").alias("hit"), F.first("all").alias("all")).where(F.col("hit") >= F.lit(COPIED) * F.col("all"))
    flat = flags.join(copies.select("path", F.lit(True).alias("copied")).distinct().hint("merge"), "path", "left")
    return flat.withColumn("copied", F.coalesce("copied", F.lit(False))).where("generated or minified or data or foreign or copied")
