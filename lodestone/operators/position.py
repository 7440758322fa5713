"""Positions and paths: smallest symbol around a point, outlines, longest-prefix joins. All joins are by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import expr

#: Lines per block. A span is listed under each block it touches, a point under one, so points and spans meet by
#: (file, block) and a huge file is spread over many keys.
BLOCK = 64


def _blocks(start, end):
    return F.explode(F.sequence(F.floor(start / BLOCK), F.floor(F.greatest(start, end) / BLOCK)))


def _holds(prefix: str, line, col):
    sl, el, sc, ec = (F.col(f"{prefix}{c}") for c in ("start_line", "end_line", "start_col", "end_col"))
    return (sl <= line) & (el >= line) & ((sl < line) | (sc <= col)) & ((el > line) | (ec >= col))


def weight(prefix: str = ""):
    return (F.col(f"{prefix}end_line") - F.col(f"{prefix}start_line")) * 1000 + (F.col(f"{prefix}end_col") - F.col(f"{prefix}start_col"))


def symbol_at(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """probes (probe_id, file_path, line, col) with the ``fqdn`` of the smallest symbol around the point, null if none;
    ties go to the least fqdn. Null positions are in no symbol."""
    s = symbols.where("start_line is not null and end_line is not null").select("file_path", "fqdn", "start_line", "end_line", "start_col", "end_col")
    s = s.withColumn("block", _blocks(F.col("start_line"), F.col("end_line")))
    p = probes.withColumn("block", F.floor(F.col("line") / BLOCK))
    hit = p.join(s, ["file_path", "block"]).where(_holds("", F.col("line"), F.col("col")))
    best = hit.groupBy("probe_id").agg(F.min_by("fqdn", F.struct(weight().alias("w"), F.col("fqdn"))).alias("fqdn"))
    return probes.join(best, "probe_id", "left")


def outline(symbols: DataFrame) -> DataFrame:
    """workspace_id, fqdn, container: the smallest other symbol of the same file whose span holds this one's (wider spans
    only, so equal spans don't hold one another); null at the top."""
    cols = ("start_line", "end_line", "start_col", "end_col")
    s = symbols.where("start_line is not null and end_line is not null").select("workspace_id", "fqdn", "file_path", *cols)
    inner = s.withColumn("block", F.floor(F.col("start_line") / BLOCK))
    outer = s.select("file_path", F.col("fqdn").alias("container"), *[F.col(c).alias(f"o_{c}") for c in cols]).withColumn("block", _blocks(F.col("o_start_line"), F.col("o_end_line")))
    inside = _holds("o_", F.col("start_line"), F.col("start_col")) & _holds("o_", F.col("end_line"), F.col("end_col")) & (weight("o_") > weight())
    best = inner.join(outer, ["file_path", "block"]).where(inside).groupBy("workspace_id", "fqdn").agg(F.min_by("container", F.struct(weight("o_").alias("w"), F.col("container"))).alias("container"))
    return s.select("workspace_id", "fqdn", "file_path").join(best, ["workspace_id", "fqdn"], "left")


def longest_prefix(rows: DataFrame, path: str, roots: DataFrame, root: str, sep: str = "/") -> DataFrame:
    """``rows`` with the columns of the root whose path is the longest whole-segment prefix; an empty root holds all.

    A path's prefixes are exploded and joined by equality; the deepest hit wins by ``max_by``, so no cross join arises.
    """
    extra = [c for c in roots.columns if c != root]
    keyed = rows.select(path).distinct()
    parts = F.filter(F.split(F.col(path), sep), lambda x: x != "") if sep == "/" else F.split(F.col(path), sep)
    lead = F.when(F.startswith(F.col(path), F.lit(sep)), sep).otherwise("")
    heads = F.concat(F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("prefix"))), expr.prefixes(parts, sep))
    ex = keyed.select(path, F.explode(heads).alias("h"), lead.alias("lead")).select(path, "h.depth", F.concat("lead", "h.prefix").alias("prefix"))
    hit = ex.join(roots.withColumnRenamed(root, "prefix"), "prefix")
    best = hit.groupBy(path).agg(F.max_by(F.struct("prefix", *extra), F.col("depth")).alias("best"))
    return rows.join(best.select(path, F.col("best.prefix").alias(root), *[F.col(f"best.{c}").alias(c) for c in extra]), path, "left")
