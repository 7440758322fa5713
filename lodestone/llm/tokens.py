"""Encoding with a public byte-level BPE vocabulary: speculate, verify, repair.

Each text is split into words by the vocabulary's pattern. For every word not yet known, greedy longest-match proposes
tokens; all adjacent proposed pairs of the batch are then checked at once for compatibility (numpy over the distinct
pairs). A sequence whose tokens and adjacent pairs all encode to themselves *is* the merge result, so only words with a
failing pair go through exact merging.

Null and empty texts have the defined ids ``[]``. Texts are encoded whole; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship, spread

#: The public pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words kept in a worker's memo before it is emptied, and the longest word kept in it.
MEMO_WORDS, MEMO_LEN = 400_000, 64


class Encoder:
    """Exact BPE of one vocabulary. ``ranks``: token bytes to id, ids in merge order."""

    def __init__(self, raw: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        self.split = regex.compile(pattern).findall
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.longest: dict[int, int] = {}
        for t in self.ranks:
            self.longest[t[0]] = max(self.longest.get(t[0], 0), len(t))
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.known = np.empty(0, np.int64)
        self.good = np.empty(0, bool)

    def propose(self, w: bytes) -> list[int]:
        """Greedy longest match from the left; every byte is a token, so it always ends."""
        ranks, out, i, n = self.ranks, [], 0, len(w)
        while i < n:
            j = min(n, i + self.longest[w[i]])
            while (t := ranks.get(w[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, w: bytes) -> list[int]:
        """Exact merging in O(n log n): a heap of candidate merges over a linked list of parts."""
        n, ranks = len(w), self.ranks
        if n < 2:
            return [ranks[w]] if n else []
        part = [w[i : i + 1] for i in range(n)]
        prev, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(w[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if part[i] else -1
            if j < 0 or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = after[j]
            if after[j] >= 0:
                prev[after[j]] = i
            if (k := after[i]) >= 0 and (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (k := prev[i]) >= 0 and (r := ranks.get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (r, k, len(part[k]) + len(part[i])))
        return [ranks[p] for p in part if p]

    def _fits(self, code: int) -> bool:
        a, b = code >> 32, code & 0xFFFFFFFF
        return self.merge(self.bytes[a] + self.bytes[b]) == [a, b]

    def _alone(self, t: int) -> bool:
        if (ok := self.alone.get(t)) is None:
            ok = self.alone[t] = self.merge(self.bytes[t]) == [t]
        return ok

    def verify(self, proposals: list[list[int]]) -> np.ndarray:
        """For each proposal: are all its adjacent pairs compatible (and a lone token its own encoding)?"""
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(proposals)), sizes)
        ok = np.ones(len(proposals), bool)
        if len(flat) > 1:
            inner = owner[1:] == owner[:-1]
            codes, own = ((flat[:-1] << 32) | flat[1:])[inner], owner[1:][inner]
            distinct, back = np.unique(codes, return_inverse=True)
            at = np.searchsorted(self.known, distinct)
            there = (at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == distinct) if len(self.known) else np.zeros(len(distinct), bool)
            fits = np.zeros(len(distinct), bool)
            if there.any():
                fits[there] = self.good[at[there]]
            if (new := distinct[~there]).size:
                fits[~there] = [self._fits(int(c)) for c in new]
                known = np.concatenate([self.known, new])
                order = np.argsort(known, kind="stable")
                self.good = np.concatenate([self.good, fits[~there]])[order]
                self.known = known[order]
            ok[own[~fits[back]]] = False
        for i in np.flatnonzero(sizes == 1):
            ok[i] = self._alone(proposals[i][0])
        return ok

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(w) for w in raw]
        ok = self.verify(proposals)
        return {w: p if good else self.merge(r) for w, r, p, good in zip(words, raw, proposals, ok)}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws}
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = self.learn([w for w in new if w not in memo]) if new else {}
        memo.update({w: t for w, t in fresh.items() if len(w) <= MEMO_LEN})
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += memo[w] if w in memo else fresh[w]
            out.append(ids)
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, ids`` (or ``key, tokens`` with ``count_only``) of every row and the columns of ``keep``; others are not read.

    The vocabulary file is read on the driver and broadcast: its size is that of the public file (below 2 MB), checked here.
    """
    spark = ship(df.sparkSession)
    with open(vocabulary, "rb") as f:
        raw = f.read()
    if len(raw) > 16 << 20:
        raise ValueError("a vocabulary file of more than 16 MB isn't broadcast")
    shared = spark.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value)
        for b in batches:
            ids = enc.encode_batch(b.column(1).to_pylist())
            if count_only:
                vals = pa.array([len(x) for x in ids], pa.int64())
            else:
                off = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=off[1:])
                flat = np.fromiter((t for x in ids for t in x), np.int32, int(off[-1]))
                vals = pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), vals, *b.columns[2:]], [key, "tokens" if count_only else "ids", *keep])

    kind = dict(df.dtypes)
    out = f"`{key}` {kind[key]}, " + ("tokens bigint" if count_only else "ids array<int>") + "".join(f", `{c}` {kind[c]}" for c in keep)
    return spread(df.select(F.col(key), F.col(text), *keep), key).mapInArrow(run, out)
