"""Source files that do not parse in the language they are recorded under.

Token streams are parsed whole by recognisers built from the bundled grammars (``grammars/*.peg``); the first token that no
parse gets past is reported. Components (.vue, .svelte) are cut into blocks first; their scripts are parsed, their markup
must nest. A text that only redeclares or misuses names is fine: only syntax counts.

Defined cases: empty texts and texts of comments are valid; a null content counts as broken if the recorded error reports
broken syntax, not if it reports reading, limits or set-up; a language that is unknown or null is taken from the path's
ending, and where that says nothing either, the text is not judged (valid). Of C conditionals every group is parsed.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.chart import Recogniser
from lodestone.functions.lexers import Script, c_picks, lex_c, lex_lua, lex_rust, lex_script
from lodestone.session import ship, spread

#: Spellings of languages and endings of their files.
LANGUAGES = {
    "rust": "rust", "rs": "rust", "rustlang": "rust", "typescript": "typescript", "ts": "typescript", "tsx": "typescript", "typescriptreact": "typescript", "javascript": "javascript", "js": "javascript", "jsx": "javascript", "javascriptreact": "javascript",
    "ecmascript": "javascript", "mjs": "javascript", "cjs": "javascript", "node": "javascript", "lua": "lua", "luajit": "lua", "c": "c", "h": "c", "ansic": "c", "c99": "c", "c11": "c", "clang": "c", "vue": "vue", "vuejs": "vue", "svelte": "svelte", "mts": "typescript", "cts": "typescript",
}
#: What scanners write when the syntax is at fault, and what they write about reading, limits and set-up.
SYNTAX_REPORT = re.compile(
    r"syntax|unexpected|expected\b|unbalanced|unterminated|unfinished|unclosed|unmatched|mismatched|missing ['\"`]?[\])};(\[{]|cannot parse|can't parse|could not parse|failed to parse|lex(?:er|ical)? error|ERROR node|delimiters? open|invalid token|illegal character|stray |token stream|"
    r"parse error(?: at|: (?:line|unexpected|expected|invalid))|parsing (?:failed|error)|erwartet|unerwartet|inattendu|attendu|inesperado|syntaxe|sintaxis|syntaxfehler|not closed|end of (?:file|input)",
    re.I,
)
OTHER_REPORT = re.compile(
    r"Cargo\.toml|package\.json|tsconfig|manifest|permission|denied|os error|no such file|not found|timed? ?out|larger than|too (?:large|big|long)|skipped|queue full|waiting|lock(?:ed| poisoned)|hash mismatch|rescan|symlink|loop detected|no provider|unsupported|encoding|utf-?8|"
    r"quota|limit|memory|cancel|abort|disk|i/o|read(?:ing)? (?:failed|error)|connection|project|workspace|config",
    re.I,
)


def language_of(language: str | None, path: str | None) -> str | None:
    for name in (re.sub(r"[^a-z0-9+#]", "", (language or "").lower()), (path or "").rsplit(".", 1)[-1].lower() if "." in (path or "") else ""):
        if name in LANGUAGES:
            return LANGUAGES[name]
    return None


def reports_syntax(error: str | None) -> bool:
    return bool(error and SYNTAX_REPORT.search(error) and not OTHER_REPORT.search(error))


@lru_cache
def _recogniser(*names: str, start: str = "start") -> Recogniser:
    return Recogniser([pkgutil.get_data("lodestone.llm", f"grammars/{n}.peg").decode() for n in names], start)


def _run(tokens: tuple, *grammar: str, start: str = "start") -> int | None:
    """Offset of the first unrecoverable error, or None."""
    types, breaks, offsets = tokens
    at = _recogniser(*grammar, start=start).check(types, breaks)
    if at < 0:
        return None
    return offsets[at] if at < len(offsets) else (offsets[-1] if offsets else 0)


def script_error(text: str, typed: bool, jsx: bool) -> int | None:
    tokens = lex_script(text, jsx)
    return _run(tokens, "javascript", "typescript") if typed else _run(tokens, "javascript")


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OPEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\w[^>]*>|<(/?)([A-Za-z][\w.:-]*)", re.S)
_ATTRS = re.compile(r"(?:[^\s\"'>/{}=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|[^\s\"'>{}]+))?|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}|\s+|/(?!>))*", re.S)
_CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)
_MUSTACHE = re.compile(r"\{\s*(?:([#/:@])\s*(\w*)(?:\s+if\b)?)?")
_EXPRESSION = frozenset(("#if", "#key", ":else", "@html", "@render"))
_NAMED = re.compile(r"[^\s\"'>/{}=]+(?:\s*=\s*)?")


def _mustache(text: str, i: int, typed: bool, stack: list[str]) -> int:
    """Offset behind the braces at ``i``, whose inside is cut into tokens and, where it is an expression, parsed; -1 when it
    isn't well formed. Opening and closing blocks go on and off ``stack``."""
    m = _MUSTACHE.match(text, i)
    inner = Script(text, False)
    end = inner.run(m.end(), True)
    if end < 0:
        return -1
    mark, word = m.group(1), m.group(2)
    if mark == "#":
        stack.append("{" + word)
    elif mark == "/":
        return end + 1 if stack and stack.pop() == "{" + word and not inner.t else -1
    elif mark == ":" and not (stack and stack[-1][0] == "{"):
        return -1
    if inner.t and (not mark or mark + word in _EXPRESSION):
        if _run((inner.t, inner.b, inner.o), "javascript", *(["typescript"] if typed else []), start="mustache") is not None:
            return -1
    return end + 1


def _tag_end(text: str, i: int, svelte: bool = False, typed: bool = False) -> tuple[int, bool]:
    """(offset behind a tag's ``>``, self-closing?) from behind its name; (-1, ...) when it isn't well formed."""
    if not svelte:
        j = _ATTRS.match(text, i).end()
    else:
        j, n = i, len(text)
        while j < n and text[j] != ">" and not text.startswith("/>", j):
            c = text[j]
            if c == "{":
                j = _mustache(text, j, typed, [])
            elif c in "\"'":
                j += 1
                while 0 <= j < n and text[j] != c:
                    j = _mustache(text, j, typed, []) if text[j] == "{" else j + 1
                j = j + 1 if 0 <= j < n else -1
            elif c.isspace() or c == "/":
                j += 1
            else:
                m = _NAMED.match(text, j)
                j = m.end() if m else -1
            if j < 0:
                return -1, False
    if text.startswith("/>", j):
        return j + 2, True
    return (j + 1, False) if text.startswith(">", j) else (-1, False)


def markup_error(text: str, base: int, svelte: bool, typed: bool = False) -> int | None:
    """Offset of the first tag, block or embedded expression that isn't well formed or doesn't nest."""
    m = _CONFLICT.search(text)
    if m and m.group(0)[0] in "<>|":
        return base + m.start()
    stack: list[str] = []
    i, nxt = 0, re.compile(_OPEN.pattern + (r"|[{}]" if svelte else r"|\{\{|\}\}"), re.S)
    while m := nxt.search(text, i):
        w = m.group(0)
        if w in ("{", "{{"):
            i = _mustache(text, m.start(), typed, stack) if svelte else Script(text, False).run(m.end(), True)
            if not svelte and i >= 0:
                i = i + 2 if text.startswith("}}", i) else -1
            if i < 0:
                return base + m.start()
            continue
        if w in ("}", "}}"):
            return base + m.start()
        if m.group(2) is None:
            if w.startswith("<!--") and not w.endswith("-->"):
                return base + m.start()
            i = m.end()
            continue
        end, selfclosing = _tag_end(text, m.end(), svelte, typed)
        if end < 0:
            return base + m.start()
        name = m.group(2)
        if m.group(1):
            if not stack or stack.pop() != name:
                return base + m.start()
        elif not selfclosing and name.lower() not in _VOID:
            stack.append(name)
        i = end
    return base + len(text) if stack else None


_STYLE = re.compile(r"/\*.*?(?P<open>\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|url\([^)\n]*\)|//[^\n]*|[{}()\[\]\"']", re.S)


def style_error(text: str, line_comments: bool = False) -> int | None:
    """Offset of the first mark of a style sheet that doesn't nest, of an open comment or an open string."""
    stack: list[str] = []
    for m in _STYLE.finditer(text):
        w = m.group()
        if w[0] == "/":
            if w[1] == "*" and not m.group("open"):
                return m.start()
            if w[1] == "/" and not line_comments:
                # No comment in plain style sheets: its marks count.
                e = style_error(w[2:])
                if e is not None:
                    return m.start() + 2 + e
        elif w in ("\"", "'"):
            return m.start()
        elif w in ("{", "(", "["):
            stack.append(w)
        elif w in ("}", ")", "]"):
            if not stack or stack.pop() != {"}": "{", ")": "(", "]": "["}[w]:
                return m.start()
    return len(text) if stack else None


def component_error(text: str, svelte: bool) -> int | None:
    """A component's blocks close, its scripts parse, its markup nests."""
    i, rest, typed = 0, [], False
    while True:
        m = re.compile(r"<!--.*?(?:-->|\Z)|<([A-Za-z][\w.-]*)", re.S).search(text, i)
        if m is None:
            rest.append((i, text[i:]))
            break
        if m.group(1) is None:
            if not m.group(0).endswith("-->"):
                return m.start()
            rest.append((i, text[i : m.start()]))
            i = m.end()
            continue
        name = m.group(1).lower()
        if svelte and name not in ("script", "style"):
            # Markup up to the next script or style block belongs together.
            nxt = re.compile(r"<(?:script|style)\b", re.I).search(text, m.end())
            stop = nxt.start() if nxt else len(text)
            rest.append((i, text[i:stop]))
            i = stop
            continue
        end, selfclosing = _tag_end(text, m.end())
        if end < 0:
            return m.start()
        rest.append((i, text[i : m.start()]))
        if selfclosing:
            i = end
            continue
        if name == "template":
            depth, j = 1, end
            for x in re.compile(r"<(/?)template\b[^>]*?(/?)>", re.I).finditer(text, end):
                depth += -1 if x.group(1) else 0 if x.group(2) else 1
                j = x.start()
                if depth == 0:
                    break
            if depth:
                return len(text)
            close = j
        else:
            x = re.compile(rf"</{re.escape(m.group(1))}\s*>", re.I).search(text, end)
            if x is None:
                return len(text)
            close = x.start()
        inner = text[end:close]
        if name == "script":
            lang = re.search(r"\blang\s*=\s*[\"']?([\w-]+)", text[m.end() : end])
            kind = (lang.group(1) if lang else "js").lower()
            typed = typed or kind in ("ts", "tsx", "typescript")
            if kind in ("ts", "tsx", "typescript", "js", "jsx", "javascript"):
                e = script_error(inner, kind in ("ts", "tsx", "typescript"), kind in ("tsx", "jsx"))
                if e is not None:
                    return end + e
        elif name == "template" and not re.search(r"\blang\s*=\s*[\"']?(?!html)", text[m.end() : end]):
            e = markup_error(inner, end, False)
            if e is not None:
                return e
        elif name == "style" and not re.search(r"\blang\s*=\s*[\"']?(?:sass|stylus)", text[m.end() : end]):
            c = _CONFLICT.search(inner)
            e = c.start() if c else style_error(inner, bool(re.search(r"\blang\s*=\s*[\"']?(?:scss|less|postcss)", text[m.end() : end])))
            if e is not None:
                return end + e
        i = text.index(">", close) + 1
    for at, part in rest:
        if svelte:
            e = markup_error(re.sub(r"(?m)^\s*//[^\n]*$", lambda x: " " * len(x.group()), part), at, True, typed)
            if e is not None:
                return e
        else:
            c = _CONFLICT.search(part)
            if c and c.group(0)[0] in "<>|":
                return at + c.start()
            x = re.search(r"</[A-Za-z]", part)
            if x:
                return at + x.start()
    return None


def first_error(text: str, language: str, path: str = "") -> int | None:
    """Offset of the first unrecoverable syntax error of a whole text, None when it parses."""
    if language == "rust":
        return _run(lex_rust(text), "rust")
    if language == "c":
        # Each group of a conditional is parsed in some variant; the first error in the text is reported.
        found = [e for p in c_picks(text) if (e := _run(lex_c(text, p), "c")) is not None]
        return min(found, default=None)
    if language == "lua":
        return _run(lex_lua(text), "lua")
    if language in ("vue", "svelte"):
        return component_error(text, language == "svelte") if text.strip() else None
    ending = path.rsplit(".", 1)[-1].lower()
    if language == "typescript":
        return script_error(text, True, ending in ("tsx", "jsx"))
    return script_error(text, False, ending != "ts")


def judge(content: str | None, language: str | None, path: str | None, error: str | None) -> tuple[bool, int | None]:
    """(broken?, line of the first error)."""
    if content is None:
        return reports_syntax(error), None
    lang = language_of(language, path)
    if lang is None or not content.strip():
        return False, None
    if "\r" in content:
        content = content.replace("\r\n", "\n").replace("\r", "\n")
    at = first_error(content, lang, path or "")
    return at is not None, None if at is None else content.count("\n", 0, at) + 1


def parsed(files: DataFrame) -> DataFrame:
    """path, content_hash, language (one spelling), project_id, broken, error_line of each stored version; narrow."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            path, content, lang, err = (b.column(i).to_pylist() for i in (0, 2, 3, 5))
            res = [judge(c, g, p, e) for p, c, g, e in zip(path, content, lang, err)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([language_of(g, p) for g, p in zip(lang, path)], pa.string()), b.column(4), pa.array([r[0] for r in res], pa.bool_()), pa.array([r[1] for r in res], pa.int32())],
                ["path", "content_hash", "language", "project_id", "broken", "error_line"],
            )

    d = spread(files.select("path", "content_hash", "content", "language", F.col("project_id").cast("int").alias("project_id"), "last_scan_error"), "path", "content_hash")
    return d.mapInArrow(run, "path string, content_hash string, language string, project_id int, broken boolean, error_line int")


def rates(judged: DataFrame, prefixes: DataFrame) -> DataFrame:
    """label, language, versions, broken, share: per project and language over distinct versions.

    ``prefixes``: label and path prefix of each project (one row per project, so small); a version belongs to the project
    with the longest prefix of its path. The prefixes of a path are exploded and joined by equality.
    """
    once = judged.groupBy("path", "content_hash").agg(F.first("language").alias("language"), F.max("broken").alias("broken"))
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("prefix")))
    exploded = once.withColumn("h", F.explode_outer(heads)).select("path", "content_hash", "language", "broken", "h.*")
    own = exploded.join(prefixes, "prefix", "left").groupBy("path", "content_hash").agg(
        F.max_by("label", F.when(F.col("label").isNotNull(), F.col("depth"))).alias("label"), F.first("language").alias("language"), F.first("broken").alias("broken"))
    return own.groupBy("label", "language").agg(F.count("*").alias("versions"), F.sum(F.col("broken").cast("int")).alias("broken"), F.avg(F.col("broken").cast("int")).alias("share"))
