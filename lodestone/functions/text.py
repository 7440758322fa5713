"""Text state machines that Column expressions can't hold: name similarity and source slices, in Arrow batches."""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import accumulate
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if not la or not lb:
        return 0.0
    reach = max(max(la, lb) // 2 - 1, 0)
    used = 0
    hits: list[str] = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), min(lb, i + reach + 1))
        while j >= 0 and used >> j & 1:
            j = b.find(c, j + 1, min(lb, i + reach + 1))
        if j >= 0:
            used |= 1 << j
            hits.append(c)
    m = len(hits)
    if not m:
        return 0.0
    other = [b[j] for j in range(lb) if used >> j & 1]
    half = sum(x != y for x, y in zip(hits, other)) // 2
    return (m / la + m / lb + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, boost_above: float = 0.7) -> float:
    """Jaro with 0.1 per leading character in common (at most four); the boost applies above ``boost_above``."""
    s = jaro(a, b)
    if s <= boost_above:
        return s
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return s + p * 0.1 * (1 - s)


def tokenize(name: str) -> list[str]:
    t = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "_", name)
    return [x for x in re.split(r"[\W_]+", t.lower()) if x]


def similarity(a: str, b: str) -> float:
    """The better of Jaro-Winkler over the lowercased names and Jaccard over their tokens; 1.0 when equal but for case."""
    x, y = a.lower(), b.lower()
    if x == y:
        return 1.0
    s, t = set(tokenize(a)), set(tokenize(b))
    jac = 1.0 if not s and not t else len(s & t) / len(s | t)
    return max(jaro_winkler(x, y), jac)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def profile(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character counts (folded into 64 bins) and lengths: cheap bounds for :func:`jaro_winkler`."""
    out = np.zeros((len(names), 64), np.int16)
    for i, n in enumerate(names):
        for c in n:
            out[i, ord(c) & 63] += 1
    return out, np.fromiter(map(len, names), np.int64, len(names))


def head_codes(names: list[str]) -> np.ndarray:
    """The first four characters of each name as numbers, -1 behind its end."""
    out = np.full((len(names), 4), -1, np.int64)
    for i, n in enumerate(names):
        for k, c in enumerate(n[:4]):
            out[i, k] = ord(c)
    return out


def reach(query: np.ndarray, length: int, counts: np.ndarray, lengths: np.ndarray, heads: np.ndarray | None = None, head: np.ndarray | None = None) -> np.ndarray:
    """What the Jaro-Winkler of the query with each name can be at most: bins only overcount common characters,
    transpositions count as none, and without heads the boost is taken as full."""
    m = np.minimum(counts, query).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        j = np.where(m > 0, (m / max(length, 1) + m / np.maximum(lengths, 1) + 1) / 3, 0.0)
    same = 4 if heads is None else np.cumprod((heads == head) & (heads >= 0), axis=1).sum(axis=1)
    return j + 0.1 * same * (1 - j) * (j > 0.7)


def may_reach(query: np.ndarray, length: int, counts: np.ndarray, lengths: np.ndarray, least: float, heads: np.ndarray | None = None, head: np.ndarray | None = None) -> np.ndarray:
    """Which names could have a Jaro-Winkler of at least ``least`` with the query? Never misses one."""
    return reach(query, length, counts, lengths, heads, head) >= least


def codes(names: list[str], width: int) -> np.ndarray:
    """Names as rows of character numbers, -1 behind their end; none may be longer than ``width``."""
    if not names or not width:
        return np.full((len(names), width), -1, np.int32)
    out = np.array(names, f"U{width}").view(np.uint32).reshape(len(names), width).astype(np.int32)
    out[np.arange(width) >= np.fromiter(map(len, names), np.int64, len(names))[:, None]] = -1
    return out


def places(table: np.ndarray, char: str) -> np.ndarray:
    """Where each row of ``codes`` (64 wide at most) has a character: bit j of a row's number stands for column j."""
    packed = np.zeros((len(table), 8), np.uint8)
    bits = np.packbits(table == ord(char), axis=1, bitorder="little")
    packed[:, : bits.shape[1]] = bits
    return packed.view(np.uint64).ravel()


@lru_cache(256)
def _windows(la: int) -> np.ndarray:
    """Per place of a query of ``la`` characters, and per reach, the bits of the places that count as near. Beside names of
    64 characters at most a longer query sets the reach alone."""
    reaches = range(32) if la <= 64 else [la // 2 - 1]
    return np.array([[((1 << 2 * r + 1) - 1 << i >> r) & 0xFFFF_FFFF_FFFF_FFFF for r in reaches] for i in range(la)], np.uint64)


def jaro_winkler_bits(query: str, at: dict[str, np.ndarray], lengths: np.ndarray, same: np.ndarray, least: float = 0.0, boost_above: float = 0.7) -> np.ndarray:
    """:func:`jaro_winkler_many` for names of 64 characters at most: ``at`` has the ``places`` of each character of the
    query, ``same`` the leading characters in common (at most four). What can't reach ``least`` is 0."""
    la, out = len(query), np.zeros(len(lengths))
    near = _windows(la)
    reach = np.maximum(np.maximum(lengths, la) // 2 - 1, 0) if la <= 64 else slice(None)
    left = np.full(len(lengths), 0xFFFF_FFFF_FFFF_FFFF, np.uint64)
    taken: list[tuple[str, np.ndarray]] = []
    for i, c in enumerate(query):
        free = at[c] & left
        free &= near[i][reach]
        free &= np.negative(free)
        if free.any():
            left ^= free
            taken.append((c, free))
    hits = np.bitwise_count(~left).astype(np.int64)

    def score(m: np.ndarray, half: np.ndarray | int, some: np.ndarray) -> np.ndarray:
        s = np.where(m > 0, (m / max(la, 1) + m / np.maximum(lengths[some], 1) + (m - half) / np.maximum(m, 1)) / 3, 0.0)
        return np.where(s > boost_above, s + same[some] * 0.1 * (1 - s), s)

    some = np.flatnonzero(score(hits, 0, np.arange(len(lengths))) >= least - 1e-9)
    used, wrong = ~left[some], np.zeros(len(some), np.int64)
    for c, got in taken:
        one = np.where(got[some] != 0, used & np.negative(used), np.uint64(0))
        wrong += (one & ~at[c][some]) != 0
        used ^= one
    out[some] = score(hits[some], wrong // 2, some)
    return out


def jaro_winkler_many(query: str, table: np.ndarray, lengths: np.ndarray, boost_above: float = 0.7) -> np.ndarray:
    """:func:`jaro_winkler` of one name with every row of ``codes``; the same assignment of characters, all rows at once."""
    n, width = table.shape
    la = len(query)
    if la == 0 or n == 0:
        return np.where(lengths == 0, 1.0, 0.0) if la == 0 else np.zeros(0)
    reach = np.maximum(np.maximum(lengths, la) // 2 - 1, 0)
    used = np.zeros((n, width), bool)
    seq_a = np.zeros((n, la), np.int32)
    hits = np.zeros(n, np.int64)
    rows = np.arange(n)
    most = int(reach.max())
    for i, c in enumerate(query):
        free = np.ones(n, bool)
        for j in range(max(0, i - most), min(width, i + most + 1)):
            take = free & (table[:, j] == ord(c)) & ~used[:, j] & (np.abs(i - j) <= reach)
            if take.any():
                used[take, j] = True
                free &= ~take
        got = ~free
        seq_a[rows[got], hits[got]] = ord(c)
        hits += got
    seq_b = np.zeros((n, la), np.int32)
    at = np.zeros(n, np.int64)
    for j in range(width):
        u = used[:, j]
        seq_b[rows[u], at[u]] = table[u, j]
        at += u
    half = (seq_a != seq_b).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(hits > 0, (hits / la + hits / np.maximum(lengths, 1) + (hits - half) / np.maximum(hits, 1)) / 3, 0.0)
    head = np.array([ord(x) for x in query[:4]], np.int32)
    k = min(4, la, width)
    same = np.cumprod(table[:, :k] == head[:k], axis=1).sum(axis=1) if k else np.zeros(n)
    return np.where(s > boost_above, s + same * 0.1 * (1 - s), s)


# -- source slices ---------------------------------------------------------------------------------------------------


#: A line that says nothing about the code below it: blank, a line comment, the inside of a comment block, or a whole block.
_QUIET = re.compile(r"[^\S\n]*(?:(?P<attr>#!?\[)[^\n]*|//[^\n]*|/\*.*?(?:\*/[^\n]*|\Z)|\*(?!/)[^\n]*)?(?:\n|\Z)", re.S)


def leading_noise(lines: list[str]) -> int:
    """How many leading lines are comments, blank, or attributes with the lines on which their brackets stay open."""
    text = "\n".join(lines)
    balance = list(accumulate(len(re.findall(r"[(\[]", s)) - len(re.findall(r"[)\]]", s)) for s in lines))
    at = n = 0
    while n < len(lines) and (m := _QUIET.match(text, at)):
        last = n + m.group().rstrip("\n").count("\n")
        if m.group("attr"):
            before = balance[n - 1] if n else 0
            last = next((k for k in range(last, len(lines)) if balance[k] <= before), len(lines) - 1)
        at += sum(len(s) + 1 for s in lines[n : last + 1])
        n = last + 1
    return n


_PIECES = re.compile(r"(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>(?<![A-Za-z0-9_])b?r(?P<h>#*)\".*?(?:\"(?P=h)|\Z))|(?P<str>\"(?:\\.|[^\"\\])*(?:\"|\Z))|(?P<tpl>`(?:\\.|[^`\\])*(?:`|\Z))", re.S)


def strip_comments(body: str) -> str:
    """Without ``//`` and ``/* */`` comments; strings, raw strings and templates stay, line breaks in comments stay."""
    return _PIECES.sub(lambda m: "" if m.lastgroup == "line" else re.sub(r"[^\n]", "", m.group()) if m.lastgroup == "block" else m.group(), body)


def collapse_blanks(body: str) -> str:
    """Runs of blank lines become one blank line, the first of the run."""
    out: list[str] = []
    for s in body.split("\n"):
        if s.strip() or not out or out[-1].strip():
            out.append(s)
    return "\n".join(out)


_LEAD = re.compile(r"[ \t]*")


def compact_indent(lines: list[str]) -> tuple[str, int, str]:
    """(text, width of the common indent taken away, unit): the indent all inked lines share goes; if what is left consists
    of blanks whose widths have a common measure of four or two, it becomes tabs; anything else stays, with an empty unit."""
    common = commonprefix([_LEAD.match(s).group() for s in lines if s.strip()])
    bare = [s.removeprefix(common) if s.startswith(common) else "" for s in lines]
    leads = {_LEAD.match(s).group() for s in bare if s.strip()} - {""}
    kinds = set("".join(leads))
    if kinds == {"\t"}:
        return "\n".join(bare), len(common), "\t"
    measure = math.gcd(*map(len, leads)) if kinds == {" "} else 0
    step = 4 if measure and measure % 4 == 0 else 2 if measure and measure % 2 == 0 else 0
    if not step:
        return "\n".join(bare), len(common), ""
    return re.sub(rf"(?m)^(?: {{{step}}})+", lambda m: "\t" * (len(m.group()) // step), "\n".join(bare)), len(common), "\t"


#: Lines end here, as in the JVM-side slices, and nowhere else.
LINE_BREAK = re.compile(r"\r?\n")


def slice_body(content: str, start: int, end: int, **options) -> dict:
    """Lines ``start`` to ``end`` (from 1) of a file through :func:`slice_lines`; out of range gives an empty body."""
    return slice_lines(LINE_BREAK.split(content)[max(0, start - 1) : end], **options)


def slice_lines(lines: list[str], max_lines: int | None = None, strip_attrs: bool = False, signature_only: bool = False, strip_inline: bool = False, collapse: bool = False) -> dict:
    """A body from its lines, options applied in fixed order."""
    total = len(lines)
    noise = leading_noise(lines) if strip_attrs else 0
    rest, cut = lines[noise:], False
    if signature_only:
        at = next((i for i, s in enumerate(rest) if "{" in s), None)
        rest, cut = (rest, False) if at is None else (rest[: at + 1], True)
    truncated = max_lines is not None and max_lines < len(rest)
    rest = rest[:max_lines] if truncated else rest
    body, prefix, unit = compact_indent(rest)
    body = strip_comments(body) if strip_inline else body
    body = collapse_blanks(body) if collapse else body
    return {"body": body, "total_body_lines": total, "stripped_lines": noise, "signature_only": cut, "truncated": truncated, "dedented_prefix_len": prefix, "indent_unit": unit}


def utf16_column(line: str, column: int) -> int:
    """UTF-16 units before character ``column``."""
    return len(line[:column].encode("utf-16-le", "surrogatepass")) // 2


def line_column(text: str, offset: int) -> tuple[int, int]:
    """(line from 1, UTF-16 column from 0) of a character offset; beyond the end counts as the end."""
    offset = max(0, min(offset, len(text)))
    at = text.rfind("\n", 0, offset) + 1
    return text.count("\n", 0, offset) + 1, utf16_column(text[at:], offset - at)


def nominal_head(ty: str) -> str:
    """Last name of a type without references, lifetimes, generics and path."""
    t = re.sub(r"^(?:&|\*(?:const|mut)\b|mut\b|dyn\b|impl\b|'\w+|\s)+", "", ty.strip())
    return re.split(r"[<(\[\s]", t, maxsplit=1)[0].rsplit("::", 1)[-1]


def generic_arguments(ty: str) -> list[str]:
    """Top-level arguments between the outermost angle brackets."""
    a, z = ty.find("<"), ty.rfind(">")
    if a < 0 or z < a:
        return []
    out, depth, cur = [], 0, ""
    for c in ty[a + 1 : z]:
        depth += c in "<([{"
        depth -= c in ">)]}"
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [x for x in (*out, cur.strip()) if x]


def substitute_generics(template: str, names: list[str], values: list[str]) -> str:
    """Type parameters in a template replaced as whole words."""
    by = dict(zip(names, values))
    return re.sub(r"\b\w+\b", lambda m: by.get(m.group(), m.group()), template)
