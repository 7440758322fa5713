"""Mixing sources to target shares of the total size in tokens, with a cap on how often a text is repeated.

Within a source every text is wanted equally often: k = wanted tokens / available tokens. floor(k) copies are certain; the
fraction is rounded by pivotal sampling: two texts pass mass between them until one is integral, so that copies always
add up and each text keeps its expectation. Texts meet in order of size, which keeps the token total close as well.
Every partition leaves at most one undecided text per source; these residuals are combined in a reduction tree.

Defined cases: null, empty or unlisted sources and null or empty texts take no part; equal texts count as one text (that
of the least doc_id with a listed source), so no text exceeds its cap under several ids; a listed source without text gets
nothing and its share is spread over the others in proportion. A null cap counts as 1, a cap below 0 as 0.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tokens import VOCABULARY, encode
from lodestone.session import cut, ship

#: Residual sets combined by one task of the reduction tree, and the most sources a mixture may list (they go to the driver).
FAN_IN, MAX_SOURCES = 64, 10_000
#: A text is long when it holds more than this share of its source's wanted tokens.
LARGE = 0.002
_COLS = "doc_id bigint, source string, tokens bigint, base int, frac double, copies int"


def uniform(seed: int, *parts: object) -> float:
    """A number in [0, 1) that a retried task draws again."""
    h = hashlib.blake2b(repr((seed, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(h, "big") / 2**64


def pivot(frac: list[float], size: list[int], names: list[object], seed: int) -> tuple[list[int | None], int | None, float]:
    """Sequential pivotal rounding: (0, 1 or None for each, index of the undecided one, its remaining probability).

    Two texts of sizes a and b with probabilities p and q pass mass so that a p + b q stays as it is and neither
    expectation changes, until one of them is decided: the tokens taken are those wanted, but for the last undecided text.
    """
    out: list[int | None] = [None] * len(frac)
    held, p = None, 0.0
    for i, q in enumerate(frac):
        if q <= 1e-9 or q >= 1 - 1e-9:
            out[i] = int(q > 0.5)
            continue
        if held is None:
            held, p = i, q
            continue
        r = size[i] / size[held]
        up, down = min(1 - p, q * r), min(p, (1 - q) * r)
        if uniform(seed, names[held], names[i]) * (up + down) < down:
            p, q = p + up, q - up / r
        else:
            p, q = p - down, q + down / r
        held_done, new_done = p <= 1e-9 or p >= 1 - 1e-9, q <= 1e-9 or q >= 1 - 1e-9
        if held_done:
            out[held] = int(p > 0.5)
        if new_done:
            out[i] = int(q > 0.5)
        if held_done:
            held, p = (None, 0.0) if new_done else (i, q)
    return out, held, p


def sized_texts(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of each distinct text of the listed sources, cut from its lineage.

    Only digests are shuffled, never texts, and equal digests meet in a partial aggregate first.
    """
    listed = targets.where("source is not null").select("source").distinct()
    d = docs.where("text is not null and text <> ''").select("doc_id", "text", "source", F.sha2("text", 256).alias("digest"))
    counted = encode(d, vocabulary=vocabulary, count_only=True, keep=("source", "digest")).join(listed, "source", "left_semi")
    one = counted.groupBy("digest").agg(F.min_by(F.struct("doc_id", "source", "tokens"), F.struct("doc_id", "source")).alias("r"))
    return cut(one.select("r.*"))


def quotas(sized: DataFrame, targets: DataFrame) -> list[tuple[str, float, int, int, float]]:
    """(source, wanted share, cap, tokens there, copies wanted of each text) of every listed source.

    The mixture is as large as the scarcest source allows at its cap. One row per source comes to the driver.
    """
    want = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("cap"))
    rows = want.join(sized.groupBy("source").agg(F.sum("tokens").alias("there")), "source", "left").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    there = [(r.source, float(r.share or 0), int(r.cap), int(r.there or 0)) for r in rows]
    usable = sum(s for _, s, cap, n in there if s > 0 and cap > 0 and n > 0)
    size = min((n * cap * usable / s for _, s, cap, n in there if s > 0 and cap > 0 and n > 0), default=0.0)
    return [(name, s, cap, n, min(float(cap), size * (s / usable) / n) if s > 0 and cap > 0 and n > 0 else 0.0) for name, s, cap, n in there]


def _level(df: DataFrame, parts: int, seed: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come ordered by source and size; what crosses a batch border is held over.
        held: pd.DataFrame | None = None
        for b in batches:
            if held is not None and len(held):
                b = pd.concat([held, b], ignore_index=True)
            ready, waiting = [], []
            final_source = b["source"].iloc[-1] if len(b) else None
            for source, g in b.groupby("source", sort=False):
                g = g.reset_index(drop=True)
                out, i, p = pivot(g["frac"].tolist(), g["tokens"].tolist(), g["doc_id"].tolist(), seed)
                g["copies"] = pd.array([None if x is None else x + n for x, n in zip(out, g["base"])], "Int32")
                if i is not None:
                    g.loc[i, "frac"] = p
                    if source == final_source:
                        waiting.append(g.iloc[[i]])
                        g = g.drop(index=i)
                ready.append(g)
            held = pd.concat(waiting, ignore_index=True) if waiting else None
            if ready:
                yield pd.concat(ready, ignore_index=True)
        if held is not None and len(held):
            yield held

    placed = df.repartition(parts, F.xxhash64("doc_id", F.lit(seed))) if parts > 1 else df.repartition(1)
    out = placed.sortWithinPartitions("source", "tokens", "doc_id").mapInPandas(run, _COLS)
    if last:
        rounded = F.col("base") + (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("frac")).cast("int")
        out = out.withColumn("copies", F.coalesce("copies", rounded))
    return cut(out)


def _rounded(rows: DataFrame, parts: int, seed: int) -> DataFrame:
    """doc_id, source, tokens, copies of ``rows`` after the reduction tree: each level leaves a text per source and task,
    and FAN_IN tasks of one level feed one task of the next."""
    done: list[DataFrame] = []
    while True:
        out = _level(rows, parts, seed, last=parts == 1)
        if parts == 1:
            done.append(out)
            break
        done.append(out.where("copies is not null"))
        rows, parts, seed = out.where("copies is null"), math.ceil(parts / FAN_IN), seed + 17
    union = done[0]
    for d in done[1:]:
        union = union.unionByName(d)
    return union.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def _wanted(rows: DataFrame, copies: list[tuple[str, float]]) -> DataFrame:
    k = rows.sparkSession.createDataFrame([(n, int(math.floor(c + 1e-9)), max(0.0, c - math.floor(c + 1e-9))) for n, c in copies], "source string, base int, frac double")
    return rows.join(F.broadcast(k), "source").select("doc_id", "source", "tokens", "base", "frac", F.lit(None).cast("int").alias("copies"))


def mix(sized: DataFrame, quota: list[tuple[str, float, int, int, float]], seed: int = 7, large: float = LARGE) -> DataFrame:
    """doc_id, source, tokens, copies (at least 1) of the mixture.

    Texts of more than ``large`` times their source's wanted tokens are decided first; the others then make up what is
    left, so that one long text can't move a source's share. Both go through the same tree over all partitions: as the goal
    is bound by the scarcest source, most texts of a small source may count as long. ``quota`` has a row per source and travels by broadcast.
    """
    spark = ship(sized.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    goal = {n: c * there for n, _, _, there, c in quota if c > 0}
    limit = spark.createDataFrame([(n, g * large) for n, g in goal.items()], "source string, most double")
    tagged = sized.join(F.broadcast(limit), "source")
    big, small = tagged.where("tokens > most"), tagged.where("tokens <= most")
    first = _rounded(_wanted(big, [(n, c) for n, _, _, _, c in quota if c > 0]), parts, seed)
    taken = {r.source: r.n for r in first.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n")).collect()}
    there = {r.source: r.n for r in small.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    left = [(n, min(float(cap), max(0.0, goal[n] - taken.get(n, 0)) / there[n])) for n, _, cap, _, c in quota if c > 0 and there.get(n)]
    return first.unionByName(_rounded(_wanted(small, left), parts, seed + 1))


def shares(mixed: DataFrame, quota: list[tuple[str, float, int, int, float]]) -> DataFrame:
    """Wanted and reached share per listed source."""
    spark = mixed.sparkSession
    want = spark.createDataFrame([(n, s, cap, there) for n, s, cap, there, _ in quota], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    j = want.join(got, "source", "left")
    total = got.agg(F.sum("tokens").alias("total"))
    return j.crossJoin(F.broadcast(total)).select(
        "source", "target_share", "max_repeats", "available_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
