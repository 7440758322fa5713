"""Pure Column expressions shared by the operators; everything here stays inside whole-stage code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that are indexed and their languages.
EXTENSIONS = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "lua": "lua", "vue": "vue", "svelte": "svelte", "c": "c", "h": "c"}
#: Names of files that stand for their folder, and per language whether a leading src folder counts.
ROOT_NAMES = ("lib", "main", "mod", "index", "init")


def glob_to_regex(pattern: str, many: str = ".*", one: str = ".") -> str:
    """Anchored regular expression of a glob: ``*``, ``?``, ``[abc]``, ``[a-c]``, ``[^x]``; everything else is literal.

    An unclosed bracket is literal. Case-sensitive; ``*`` also matches separators and line breaks.
    """
    out, i = "(?s)^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += many
        elif c == "?":
            out += one
        elif c == "[" and (j := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : j]
            neg = body[:1] in ("^", "!")
            out += "[" + ("^" if neg else "") + re.sub(r"([\\\[&^])", r"\\\1", body[1:] if neg else body) + "]"
            i = j
        else:
            out += re.escape(c) if c.isascii() else c
        i += 1
    return out + "$"


def glob(col: Column, pattern: str) -> Column:
    """Null stays null."""
    return col.rlike(glob_to_regex(pattern))


def extension(path: Column) -> Column:
    """Ending behind the last dot of the file name; empty where there is none."""
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language_of_path(path: Column) -> Column:
    """Language by extension; null for anything that isn't indexed."""
    pairs = [x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[extension(path)]


def segments(fqdn: Column) -> Column:
    return F.split(fqdn, "::")


def last_segment(fqdn: Column) -> Column:
    return F.element_at(segments(fqdn), -1)


def parent(fqdn: Column) -> Column:
    """The path without its last segment; null at the top."""
    return F.when(F.contains(fqdn, F.lit("::")), F.regexp_replace(fqdn, r"::(?:(?!::).)*$", ""))


def prefixes(parts: Column, sep: str) -> Column:
    """All leading joins of an array of segments as structs (depth, prefix), shortest first."""
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), sep).alias("prefix")))


def relative_to(fqdn: Column, base: str) -> Column:
    """``fqdn`` below ``base``: empty at the base itself, cut on whole segments, unchanged elsewhere."""
    return F.when(fqdn == base, "").when(F.startswith(fqdn, F.lit(base + "::")), F.substring(fqdn, len(base) + 3, 1_000_000)).otherwise(fqdn)


def test_like_fqdn(fqdn: Column, neighbour: bool = False) -> Column:
    """Does a path name test code? Neighbours are judged without the bare ``::tests`` / ``::test`` endings."""
    c = F.contains(fqdn, F.lit("::tests::")) | F.contains(fqdn, F.lit("::test::"))
    for end in ("_test", "_tests", ".test", ".spec", *(() if neighbour else ("::tests", "::test"))):
        c = c | F.endswith(fqdn, F.lit(end))
    return c


def test_like_path(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    c = F.lit(False)
    for mid in ("/tests/", "/test/", "/__tests__/"):
        c = c | F.contains(p, F.lit(mid))
    for end in ("_test.rs", "_tests.rs", *(f".{k}.{x}" for k in ("test", "spec") for x in ("ts", "tsx", "js", "jsx"))):
        c = c | F.endswith(p, F.lit(end))
    return c


def is_test(fqdn: Column, path: Column) -> Column:
    return F.coalesce(test_like_fqdn(fqdn), F.lit(False)) | F.coalesce(test_like_path(path), F.lit(False))


def tokens(name: Column) -> Column:
    """Identifier tokens, lowercased: split at other characters, lower or digit before upper, letter beside digit.
    Acronyms stay whole; an empty name has none; null stays null."""
    t = F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])", "_")
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 1.0 when both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def search_terms(text: Column) -> Column:
    """Terms of full-text search: letters and digits, lowercased, without diacritics; order and repeats kept."""
    plain = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda x: x != "")


def module_path(path: Column, roots: tuple[str, ...] = ROOT_NAMES) -> Column:
    """Module of a file: behind its last ``src`` folder, without extension, a root name standing for its folder."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:.*/)?src/", "")
    parts = F.filter(F.split(F.regexp_replace(p, r"\.[^./]+$", ""), "/"), lambda x: x != "")
    last = F.element_at(parts, -1)
    cut = F.when(last.isin(*roots), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(cut, "::"))


#: Declaration and language kinds by family.
FAMILIES = {
    "callable": "callable function fn method impl_fn trait_fn constructor local_function fn_decl closure macro_fn".split(),
    "type": "type struct enum union trait class interface type_alias typedef".split(),
    "value": "value const constant static let var variable field tuple_field property static_property enum_variant enum_member global local".split(),
    "module": "module namespace package crate".split(),
    "macro": "macro macro_rules proc_macro decorator macro_object".split(),
}


def family(kind: Column) -> Column:
    k, out = F.lower(kind), None
    for name, words in FAMILIES.items():
        out = F.when(k.isin(*words), name) if out is None else out.when(k.isin(*words), name)
    return out.otherwise("unknown")


def render_signature(name: Column, signature: Column) -> Column:
    """``async name(a: T = d, b) -> R`` with white space runs made one blank; a null signature gives null."""
    def param(p: Column) -> Column:
        return F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["ty"]), F.lit("")), F.coalesce(F.concat(F.lit(" = "), p["default"]), F.lit("")))

    text = F.concat(
        F.when(F.coalesce(signature["is_async"], F.lit(False)), "async ").otherwise(""), name, F.lit("("),
        F.array_join(F.transform(F.coalesce(signature["params"], F.array()), param), ", "), F.lit(")"), F.coalesce(F.concat(F.lit(" -> "), signature["returns"]), F.lit("")),
    )
    return F.when(signature.isNotNull(), F.regexp_replace(text, r"\s+", " "))


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    """A limit or depth within its bounds; None gives the default."""
    return default if value is None else max(low, min(high, int(value)))


def threshold(value: float | None, default: float) -> float:
    """A finite number in [0, 1]; anything else raises."""
    v = default if value is None else float(value)
    if not 0.0 <= v <= 1.0:
        raise ValueError("a threshold lies between 0 and 1")
    return v


def to_json_text(value: Column) -> Column:
    """Nested values as JSON text; null fields are left out, null stays null."""
    return F.to_json(value)


def from_json_text(text: Column, ddl: str) -> Column:
    """Nested values from JSON text; null, and text that is none, give null."""
    return F.from_json(text, ddl)
