"""Per-key results when a few keys hold most rows.

Heavy hitters are found by a mergeable frequent-items sketch (``approx_top_k``; it is merged map-side, no rows move), then
counted exactly. Rows of heavy keys are spotted by a broadcast join with the candidate list, whose size is bounded by the
share asked for, and aggregated in two levels salted by the measure; all other keys take one ordinary shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key whose share is at least SHARE is reported as heavy; a key with more than 1 / HOT of the rows gets tasks of its own
#: in :func:`skew_safe_semi`.
SHARE, HOT = 0.02, 512
#: Fewest and most counters of a sketch; the latter is the function's own limit.
LEAST_TRACKED, MOST_TRACKED = 4096, 1_000_000


def sketch_size(share: float) -> tuple[int, int]:
    """(candidates, counters) that are enough for every key of at least ``share`` of the rows.

    A sketch of m counters is off by at most 3.5 / m of the rows. With m >= 8 / share that is below half the share, so the
    items it returns for sure hold more than half of ``share`` each: there are fewer than 2 / share of them.
    """
    if not 8 / MOST_TRACKED <= share <= 1:
        raise ValueError(f"share must lie between {8 / MOST_TRACKED} and 1, not {share}")
    return math.ceil(2 / share), max(LEAST_TRACKED, 2 ** math.ceil(math.log2(8 / share)))


def candidates(rows: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """Values of ``key`` that may hold ``share`` of the non-null rows, with their estimate (never too low): every heavy one is
    among them, and there are at most 2 / share. Nulls are no values; an empty input gives no rows."""
    top, tracked = sketch_size(share)
    sk = rows.where(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {top}, {min(tracked, MOST_TRACKED)})").alias("t"), F.count("*").alias("n"))
    found = sk.select("n", F.explode("t").alias("x")).where(F.col("x.count") >= F.lit(share) * F.col("n"))
    return found.select(F.col("x.item").alias(key), F.col("x.count").alias("estimate"))


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> DataFrame:
    """``key, n, total``: the keys that hold at least ``share`` of the non-null rows, with exact counts."""
    some = rows.where(F.col(key).isNotNull()).select(key)
    cand = F.broadcast(candidates(some, key, share).select(key))
    exact = some.join(cand, key).groupBy(key).agg(F.count("*").alias("n"))
    total = some.agg(F.count("*").alias("total"))
    return exact.crossJoin(F.broadcast(total)).where(F.col("n") >= F.lit(share) * F.col("total"))


def per_key(rows: DataFrame, key: str, member: str, at: str, share: float = SHARE) -> DataFrame:
    """For each non-null key: rows, distinct members, first and last time; keys that may hold ``share`` of the rows and
    ordinary ones on their own ways.

    Null members and times don't count in theirs; a key with null members only has zero of them.
    """
    d = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(member).alias("m"), F.col(at).alias("t"))
    heavy = F.broadcast(candidates(d, "k", share).select("k"))
    hot = d.join(heavy, "k", "left_semi")
    rest = d.join(heavy, "k", "left_anti")
    level1 = hot.groupBy("k", "m").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    hot_out = level1.groupBy("k").agg(F.sum("n").alias("rows"), F.count("m").alias("members"), F.min("a").alias("first_ms"), F.max("b").alias("last_ms"))
    rest_out = rest.groupBy("k").agg(F.count("*").alias("rows"), F.countDistinct("m").alias("members"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"))
    return hot_out.unionByName(rest_out).withColumnRenamed("k", key)


def hot_keys(counts: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Hashes of the HOT keys with the greatest counts, whatever the data: any key with more than 1 / HOT of all rows is one of
    them (a top-k that is taken per task first)."""
    return counts.orderBy(F.desc(n), *on).limit(HOT).select(F.xxhash64(*on).alias("__h"))


def skew_safe_semi(big: DataFrame, keys: DataFrame, on: list[str], spread: Column, hot: DataFrame | None = None) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys`` (distinct keys), in one shuffle.

    Rows of hot keys are salted by ``spread`` over all shuffle partitions and their keys repeated once per salt; all others
    have one salt, so nothing else is repeated. ``hot`` are hashes as :func:`hot_keys` gives them; without it a sketch over
    ``big`` finds them. Either way there are at most 2 HOT, and the list is broadcast. Null keys match nothing.
    """
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if hot is None:
        hot = candidates(big.select(F.xxhash64(*on).alias("__h")), "__h", 1 / HOT).select("__h")
    marked = F.broadcast(hot.select("__h", F.lit(True).alias("__hot")))
    salted = big.withColumn("__h", F.xxhash64(*on)).join(marked, "__h", "left")
    salted = salted.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0)).drop("__h", "__hot")
    many = keys.select(*on, F.xxhash64(*on).alias("__h")).join(marked, "__h", "left")
    many = many.select(*on, F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"))
    return salted.join(many, [*on, "__salt"], "left_semi").drop("__salt")
