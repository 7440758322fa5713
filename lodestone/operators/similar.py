"""Similar names: the better of Jaro-Winkler and token Jaccard, for a stated query set against all names, in blocks."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import codes, jaro_winkler, jaro_winkler_bits, places, profile, reach, tokenize
from lodestone.operators.lookup import first_per
from lodestone.session import ship, stored

#: Query names per block and names per slice, at most.
BLOCK, SLICE = 4000, 200_000
#: Names up to this length are scored all at once; longer ones one by one.
WIDTH = 64
#: Names are scored in steps of what they can reach, so many at least at once, whose place in 64 characters is kept.
STEP, ATONCE, KEPT = 0.02, 128, 64


def _level(bound: np.ndarray, least: float) -> np.ndarray:
    """Steps below 1.0 of what a name can reach; 255 where that is less than ``least``."""
    return np.where(bound >= least - 1e-9, np.clip((1.0 - bound) / STEP, 0, 254), 255).astype(np.uint8)


@lru_cache(256)
def _levels(la: int, least: float) -> np.ndarray:
    """The level by characters in common, length of the name and leading characters in common, for queries of ``la``."""
    m, lb, same = np.ogrid[: WIDTH + 1, : WIDTH + 1, :5]
    j = np.where((m > 0) & (lb > 0), (m / max(la, 1) + m / np.maximum(lb, 1) + 1) / 3, 0.0)
    return _level(j + 0.1 * same * (1 - j) * (j > 0.7), least).ravel()


class Names:
    """A slice of names made ready for scoring queries against all of them. ``weights``: how many rows stand behind each."""

    def __init__(self, names: list[str], weights: list[int] | None = None) -> None:
        self.names = np.array(names, object)
        self.weights = np.ones(len(names), np.int64) if weights is None else np.array(weights, np.int64)
        self.low = [x.lower() for x in names]
        self.lengths = np.fromiter(map(len, self.low), np.int64, len(names))
        short = self.lengths <= WIDTH
        self.far = np.flatnonzero(~short)
        self.is_far = ~short
        self.table = codes([x if k else "" for x, k in zip(self.low, short)], int(self.lengths[short].max(initial=0)))
        self.heads = np.ascontiguousarray(codes([x[:4] for x in self.low], 4).T)
        self.row = (np.where(short, self.lengths, 0) * 5).astype(np.uint16)
        self.far_profile = profile([self.low[i] for i in self.far])
        self.equal: dict[str, list[int]] = {}
        for i, x in enumerate(self.low):
            self.equal.setdefault(x, []).append(i)
        by_token: dict[str, list[int]] = {}
        own = [set(tokenize(x)) for x in names]
        for i, t in enumerate(own):
            for w in t or ("",):
                by_token.setdefault(w, []).append(i)
        self.own = np.fromiter((len(t) for t in own), np.int64, len(names))
        self.by_token = {w: np.array(v, np.int32) for w, v in by_token.items()}
        self.shared = np.zeros(len(names), np.int32)
        self.done = np.zeros(len(names), bool)
        self.kept: dict[str, tuple[np.ndarray, list[np.ndarray]]] = {}
        self.head: tuple[str | None, np.ndarray, np.ndarray] = (None, self.row, self.row)

    def at(self, char: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Places of a character in every name; and 1 where it occurs at least once, twice and so on, up to four times."""
        if char not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            p = places(self.table, char)
            n = np.bitwise_count(p)
            self.kept[char] = p, [(n >= k).view(np.uint8) for k in range(1, min(4, int(n.max(initial=0))) + 1)]
        return self.kept[char]

    def same_head(self, x: str) -> tuple[np.ndarray, np.ndarray]:
        """Leading characters in common, at most four, and the part of the place in ``_levels`` that hangs on them."""
        if self.head[0] != x[:4]:
            same, on = np.zeros(len(self.low), np.uint8), np.ones(len(self.low), bool)
            for column, c in zip(self.heads, x[:4]):
                on &= column == ord(c)
                same += on
            self.head = x[:4], same, self.row + same
        return self.head[1:]

    def token_score(self, name: str, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Names whose tokens score at least ``least``, and their score."""
        t = set(tokenize(name))
        lists = [self.by_token[w] for w in t or ("",) if w in self.by_token]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0)
        for v in lists:
            self.shared[v] += 1
        near = np.concatenate(lists)
        n = self.shared[near]
        # What has no token shares the empty one: 1 of 1.
        score = n / (max(len(t), 1) + np.maximum(self.own[near], 1) - n)
        self.shared[near] = 0
        near, first = np.unique(near[score >= least], return_index=True)
        return near, score[score >= least][first]

    def name_score(self, x: str, some: np.ndarray, least: float) -> np.ndarray:
        """Jaro-Winkler of a lowercased query with some of the names; what can't reach ``least`` may be 0."""
        out = np.zeros(len(some))
        far = self.is_far[some]
        easy = some[~far]
        step = max(64, min(8192, (1 << 22) // max(1, len(x))))
        parts = [easy[k : k + step] for k in range(0, len(easy), step)]
        if parts:
            out[~far] = np.concatenate([jaro_winkler_bits(x, {c: self.at(c)[0][p] for c in set(x)}, self.lengths[p], self.same_head(x)[0][p], least) for p in parts])
        if far.any():
            out[far] = [jaro_winkler(x, self.low[i]) for i in some[far]]
        return out

    def best(self, name: str, least: float, top: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and scores of the names that score at least ``least``; with ``top`` only those among the best ``top`` rows,
        ties included. Names are scored in the order of what they can reach at most (characters in common, none transposed),
        so that a query is done once its best can't be beaten."""
        x = name.lower()
        equal = self.equal.get(x, [])
        self.done[equal] = True
        found, score = self.token_score(name, least)
        score, found = score[~self.done[found]], found[~self.done[found]]
        score = np.maximum(score, self.name_score(x, found, least)) if x else score
        tokens = found
        self.done[tokens] = True
        floor = least

        def rise() -> float:
            by = np.argsort(-score)
            k = int(np.searchsorted(np.cumsum(self.weights[found[by]]), top))
            # Scores within a rounding of the last one are ties.
            return max(floor, score[by[k]] - 2e-6) if k < len(by) else floor

        if top is not None:
            floor = rise()
        if x:
            common = np.zeros(len(self.low), np.uint8)
            for c, n in Counter(x).items():
                where, some = self.at(c)
                for each in some[:n]:
                    common += each
                if n > 4 and len(some) == 4:
                    common += np.clip(np.bitwise_count(where), 4, min(n, WIDTH)) - np.uint8(4)
            level = _levels(len(x), least).take(common * np.uint16(5 * WIDTH + 5) + self.same_head(x)[1])
            if len(self.far):
                q, n = profile([x])
                level[self.far] = _level(reach(q[0], int(n[0]), *self.far_profile, codes([self.low[i][:4] for i in self.far], 4), codes([x[:4]], 4)[0]), least)
            last = int((1.0 - least) / STEP + 1e-6) + 1
            waiting: list[np.ndarray] = []
            for k in range(last + 1):
                over = k == last or floor > 1.0 - STEP * k + 1e-9
                if not over:
                    part = np.flatnonzero(level == k)
                    waiting.append(part[~self.done[part]])
                if over or sum(map(len, waiting)) >= ATONCE:
                    part = np.concatenate([found[:0], *waiting])
                    s = self.name_score(x, part, floor)
                    found, score, waiting = np.concatenate([found, part[s >= floor]]), np.concatenate([score, s[s >= floor]]), []
                    if top is not None:
                        floor = rise()
                        found, score = found[score >= floor], score[score >= floor]
                if over:
                    break
        self.done[equal] = False
        self.done[tokens] = False
        return found[score >= floor], score[score >= floor]


#: The last slice a worker made ready; its other blocks find it here.
_LAST: dict[tuple[str, int], Names] = {}


def _ready(key: tuple[str, int], names: pd.DataFrame) -> Names:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Names(names["name"].tolist(), names["weight"].tolist())
    return _LAST[key]


def name_scores(queries: DataFrame, names: DataFrame, least: float = 0.6, top: int | None = None) -> DataFrame:
    """query, name, score for each pair of distinct names that differ in more than case and score at least ``least``.

    queries and names: one string column ``name`` each. Names meet the queries as classes of equal text, so repeated names
    cost nothing. Queries are cut into blocks of BLOCK and names into slices of SLICE at most, with more blocks where
    cores would idle; each block meets each slice in one cogroup, so no task holds more than a block and a slice, and the
    plan doesn't grow with either. With ``top`` a pair is dropped once a slice has that many better rows of ``names`` for its
    query (ties stay): no pair of the best ``top`` rows is lost. Nulls take no part; an empty name is only similar to nothing.
    """
    spark = ship(names.sparkSession)
    cores = spark.sparkContext.defaultParallelism
    q = stored(queries.where("name is not null").select("name").distinct(), "asked")
    every = stored(names.where("name is not null").groupBy("name").agg(F.count("*").alias("weight")), "names")
    asked, slices = q.count(), max(1, math.ceil(every.count() / SLICE))
    blocks = max(1, math.ceil(asked / BLOCK), min(math.ceil(4 * cores / slices), math.ceil(asked / 200)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores, min(blocks * slices, 16 * cores))
    left = q.select(F.col("name").alias("query"), F.pmod(F.xxhash64("name", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    right = every.select("name", "weight", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int").alias("slice"))
    call = uuid.uuid4().hex

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "name": [], "score": []}).astype({"query": object, "name": object})
        some = _ready((call, int(b["slice"].iloc[0])), b)
        rows = [(x, *some.best(x, least, top)) for x in sorted(a["query"].tolist(), key=str.lower)]
        found = np.concatenate([i for _, i, _ in rows])
        return pd.DataFrame({"query": np.repeat(np.array([x for x, _, _ in rows], object), [len(i) for _, i, _ in rows]), "name": some.names[found], "score": np.concatenate([s for _, _, s in rows])})

    # A set number of partitions keeps the few but costly groups from being coalesced into one task.
    left, right = left.repartition(parts, "block", "slice"), right.repartition(parts, "block", "slice")
    return left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInPandas(run, "query string, name string, score double")


def similar_symbols(queries: DataFrame, symbols: DataFrame, least: float = 0.6, limit: int = 20) -> DataFrame:
    """query, fqdn, score, rank: the best symbols per query name, score first, then path; symbols of the query's own name
    (but for case) are left out. ``symbols``: fqdn, name, already filtered.

    Symbols of one name score alike, so only the first ``limit`` paths of a name can be among the best: a name that a
    tenth of all symbols have sends ``limit`` rows to the join."""
    first = stored(first_per(symbols.where("name is not null").select("fqdn", "name"), ["name"], ["fqdn"], limit).drop("rank"), "similar")
    scores = name_scores(queries, first.select("name"), least, limit)
    hits = scores.join(first, "name").withColumn("score", F.round("score", 6))
    return first_per(hits, ["query"], [F.desc("score"), "fqdn"], limit).select("query", "fqdn", "score", "rank")


def did_you_mean(requests: DataFrame, symbols: DataFrame, least: float = 0.6, limit: int = 5) -> DataFrame:
    """Suggestions for request names that no symbol has; a glob is judged by what is left without ``*?[]``."""
    core = requests.select(F.regexp_replace("name", r"[*?\[\]]", "").alias("name")).where("length(name) > 0").distinct()
    missing = core.join(symbols.select("name").distinct(), "name", "left_anti")
    return similar_symbols(missing, symbols, least, limit)
