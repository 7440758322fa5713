"""Maintenance of the index: keyed upserts, diffs, staleness, ignore rules, recent-use memory.

Tables are plain DataFrames; each operator maps old and new rows to the new snapshot, so a retry gives the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.expr import glob_to_regex


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot after writing ``new`` over ``old`` by key; columns of ``keep`` stay as they were where they were set.

    Of several new rows of a key the last by ``order`` wins (columns of ``new``, which needn't be stored), then the greatest
    by all columns, compared one after the other, nulls least. Repeated rows are one row. ``max_by`` folds before the
    shuffle."""
    cols = [c for c in old.columns if c not in key]
    rank = F.struct(*[F.col(c) for c in order]) if order else F.struct(F.lit(0).alias("none"))
    both = old.withColumn("__gen", F.lit(0)).withColumn("__order", F.lit(None)).unionByName(new.select(*old.columns, F.lit(1).alias("__gen"), rank.alias("__order")))
    by = F.struct("__gen", "__order", *cols)
    agg = both.groupBy(*key).agg(F.max_by(F.struct(*cols) if cols else F.struct(F.lit(0)), by).alias("__r"), *[F.max(F.when(F.col("__gen") == 0, F.col(c))).alias(f"__k_{c}") for c in keep])
    return agg.select(*key, *[F.coalesce(f"__k_{c}", F.col("__r")[c]).alias(c) if c in keep else F.col("__r")[c].alias(c) for c in cols]).select(*old.columns)


def delete_by(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't in ``keys``; null keys stay."""
    return rows.join(keys.select(*on).distinct(), on, "left_anti").select(*rows.columns)


def replace_by(rows: DataFrame, new: DataFrame, on: list[str], touched: DataFrame | None = None) -> DataFrame:
    """All rows of the touched owners (files, modules) make room for ``new``. Owners without new rows lose theirs when they
    are in ``touched``."""
    gone = (new if touched is None else touched).select(*on).distinct()
    return delete_by(rows, gone, on).unionByName(new.select(*rows.columns))


def first_write_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in cols]).select(*rows.columns)


def diff(existing: DataFrame, extracted: DataFrame, key: list[str], hash_col: str = "body_hash", position: tuple[str, ...] = ("start_line", "start_col", "end_line", "end_col")) -> DataFrame:
    """key, change: insert, modify (hashes differ, null against set too), position, same or delete, by full outer join."""
    a = existing.select(*key, F.struct(hash_col, *position).alias("a"))
    b = extracted.select(*key, F.struct(hash_col, *position).alias("b"))
    same_pos = F.lit(True)
    for c in position:
        same_pos = same_pos & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    change = (
        F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete")
        .when(~F.col(f"a.{hash_col}").eqNullSafe(F.col(f"b.{hash_col}")), "modify").when(~same_pos, "position").otherwise("same")
    )
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def apply_files(symbols: DataFrame, edges: DataFrame, new_symbols: DataFrame, new_edges: DataFrame, touched: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) after a batch of files: symbols of the touched files are replaced (unchanged ones keep their
    revision), edges are replaced for every symbol of a touched file, so their sites can't go stale."""
    paths = touched.select("file_path").distinct()
    old = symbols.join(paths, "file_path", "left_semi")
    rev = old.select("workspace_id", "fqdn", F.col("body_hash").alias("__h"), F.col("last_modified_revision").alias("__rev"))
    stamped = new_symbols.join(rev, ["workspace_id", "fqdn"], "left").withColumn("last_modified_revision", F.when(F.col("__h").eqNullSafe(F.col("body_hash")) & F.col("__rev").isNotNull(), F.col("__rev")).otherwise(F.lit(revision).cast("bigint")))
    s = replace_by(symbols, stamped.select(*symbols.columns), ["file_path"], touched=paths)
    owners = old.select("workspace_id", F.col("fqdn").alias("from_fqdn")).unionByName(new_symbols.select("workspace_id", F.col("fqdn").alias("from_fqdn"))).distinct()
    return s, replace_by(edges, new_edges, ["workspace_id", "from_fqdn"], touched=owners)


def staleness(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (fqdn, fetched_at) with ``state``: missing, stale (changed after it was fetched) or fresh. A null
    fetched_at is stale."""
    s = symbols.groupBy("fqdn").agg(F.max("last_modified_revision").alias("rev"))
    j = requests.join(s, "fqdn", "left")
    return j.select("fqdn", "fetched_at", F.when(F.col("rev").isNull(), "missing").when(F.col("fetched_at").isNull() | (F.col("rev") > F.col("fetched_at")), "stale").otherwise("fresh").alias("state"))


def last_good(versions: DataFrame) -> DataFrame:
    """path, content_hash, error, good_hash: current versions with a recorded error beside the last version without one."""
    bad = F.coalesce(F.col("last_scan_error"), F.lit("")) != ""
    g = versions.groupBy("path").agg(
        F.max_by(F.struct("content_hash", "last_scan_error"), F.struct("last_scanned_ms", "content_hash")).alias("cur"),
        F.max_by("content_hash", F.when(~bad, F.struct("last_scanned_ms", "content_hash"))).alias("good_hash"),
    )
    return g.where("coalesce(cur.last_scan_error, '') <> ''").select("path", "cur.content_hash", F.col("cur.last_scan_error").alias("error"), "good_hash")


# -- ignore rules ----------------------------------------------------------------------------------------------------


def ignore_regex(pattern: str, base: str = "") -> tuple[str, bool]:
    """(regular expression over root-relative paths, negated?) of one line of an ignore file in folder ``base``.

    A leading ``!`` negates, a slash inside anchors to the folder, ``**`` spans folders, a trailing slash means folders;
    a folder that matches takes all below it along. Blank lines and comments match nothing.
    """
    p = pattern.strip()
    if not p or p.startswith("#"):
        return r"(?!)", False
    neg = p.startswith("!")
    p = p[1:] if neg else p
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out = ""
    for piece in re.split(r"(\*\*/|/\*\*|\*\*)", p):
        if piece == "**/":
            out += "(?:.*/)?"
        elif piece == "/**":
            out += "/.*"
        elif piece == "**":
            out += ".*"
        else:
            out += glob_to_regex(piece, "[^/]*", "[^/]")[5:-1]
    root = re.escape(base.rstrip("/") + "/") if base else ""
    return f"^{root}{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$", neg


def ignored(path: Column, layers: list[tuple[str, list[str]]]) -> Column:
    """Is a path ignored by layers of (folder, lines)? The deepest layer with an opinion wins, in it the last line."""
    verdict: Column | None = None
    rules = [(base, i, line) for base, lines in sorted(layers, key=lambda x: x[0].count("/") + bool(x[0])) for i, line in enumerate(lines)]
    for base, _, line in reversed(rules):
        rx, neg = ignore_regex(line, base)
        c = path.rlike(rx)
        verdict = F.when(c, F.lit(not neg)) if verdict is None else verdict.when(c, F.lit(not neg))
    return F.lit(False) if verdict is None else verdict.otherwise(F.lit(False))


def filter_change(paths: DataFrame, path: str, before: list[tuple[str, list[str]]], after: list[tuple[str, list[str]]]) -> DataFrame:
    """path, change: newly_excluded or newly_allowed."""
    a, b = ignored(F.col(path), before), ignored(F.col(path), after)
    return paths.select(F.col(path), F.when(~a & b, "newly_excluded").when(a & ~b, "newly_allowed").alias("change")).where("change is not null").distinct()


def preview(paths: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """path, total, truncated: the first matches of an ignore pattern and how many there are."""
    hit = paths.where(F.col(path).rlike(ignore_regex(pattern)[0])).select(path).distinct()
    n = hit.agg(F.count("*").alias("total"))
    return hit.orderBy(path).limit(limit).crossJoin(F.broadcast(n)).withColumn("truncated", F.col("total") > limit)


def recent_use(events: DataFrame, key: str, ts: str, window_s: int = 300) -> DataFrame:
    """The events with ``recent``: did the same key have an earlier event at most ``window_s`` seconds before?

    Seconds are put into blocks of the window's length, and each event also looks into its successor's block, so a busy key
    is spread over its blocks and no task gathers all of a key's events. Events of the same second count as earlier ones
    only when they are in an earlier second.
    """
    sec = F.col(ts).cast("timestamp").cast("bigint")
    e = events.withColumn("__s", sec)
    d = e.select(key, "__s").distinct()
    block = F.floor(F.col("__s") / window_s)
    src = d.select(key, F.col("__s").alias("p"), F.explode(F.array(block, block + 1)).alias("b"))
    hit = d.withColumn("b", block).join(src, [key, "b"]).where((F.col("p") < F.col("__s")) & (F.col("p") >= F.col("__s") - window_s)).select(key, "__s").distinct().withColumn("recent", F.lit(True))
    return e.join(hit, [key, "__s"], "left").withColumn("recent", F.coalesce("recent", F.lit(False))).drop("__s")
