"""Functions and methods paired with their documentation.

Signatures are found by one regular expression per language; a body ends where its brace, end-keyword or indentation stack
is empty again (strings and comments are skipped); a documentation comment belongs to the signature that follows it within
``GAP`` lines, lint and attribute lines not counted. A text documents something when words about behaviour, use, result or
limits are left after marks, placeholders, bare tags, pointers, notices and the function's own name are taken away.

Defined cases: null and blank bodies give no pair; null and blank texts say nothing; a name that is null restates nothing;
cut bodies end where the text ends. Any number of texts per function: one good one is enough, the first in text order of
the best source (the comment in the body, then the table) is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship, spread

GAP = 1

#: Signature lines per language; group 1 is the name.
SIGNATURES = {
    "rust": re.compile(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)", re.M),
    "typescript": re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*(?:function\s*\*?\s*(\w+)|(?!(?:if|for|while|switch|catch|return|function|new|typeof|await|else|do|super|constructor_)\b)[#*]?(\w+)\s*(?:<[^>{}]*>)?\s*\([^;{}]*\)\s*(?::[^;{}=]+)?\{|(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|\w+\s*=>))", re.M),
    "lua": re.compile(r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)\s*\(|^[ \t]*(?:local\s+)?([\w.]+)\s*=\s*function\s*\(", re.M),
    "c": re.compile(r"^(?!\s*(?:if|for|while|switch|return|else|do|typedef)\b)[ \t]*(?:[A-Za-z_][\w]*[\s*]+)+(\w+)\s*\([^;{}]*\)\s*\{", re.M),
    "python": re.compile(r"^[ \t]*(?:async\s+)?def\s+(\w+)", re.M),
    "ruby": re.compile(r"^[ \t]*def\s+([\w.?!=]+)", re.M),
}
BY_EXTENSION = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "vue": "typescript", "svelte": "typescript", "lua": "lua", "c": "c", "h": "c", "py": "python", "rb": "ruby"}

_MARKS_OF = r"|=>|[{}()\[\];\n]"
_REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/"
#: Comments and literals, which hide marks, and the marks themselves; scripts have long strings in either quotes and patterns.
_BRACES = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'" + _MARKS_OF, re.S)
_SCRIPT_BRACES = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[(=,:;!&|?\[{}] )" + _REGEX + r"|(?<=[(=,:;!&|?\[{}\n])" + _REGEX + r"|(?<=return )" + _REGEX + _MARKS_OF, re.S)
_ENDS = re.compile(r"--\[(=*)\[.*?(?:\]\1\]|\Z)|--[^\n]*|\[(=*)\[.*?\]\2\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\b(?:function|if|do|repeat|end|until|while|for|def|class|module|begin|case|unless)\b", re.S)
_DOC_LINE = {"rust": ("///", "//!", "/**"), "typescript": ("/**",), "c": ("/**", "/*!", "///", "//!"), "lua": ("---", "--[["), "python": ("#",), "ruby": ("#",)}
_SKIP_LINE = re.compile(r"^\s*(?:#!?\[.*\]|@\w[\w.]*(?:\(.*\))?|//\s*(?:eslint|prettier|tslint|@ts-|NOLINT|clang-format|istanbul|biome|rustfmt|noinspection|c8|jshint|jscs|spell-?check|cspell).*|--\s*(?:luacheck|selene|stylua|@diagnostic).*|#\s*(?:noqa|pylint|type:|rubocop).*|/\*\s*(?:eslint|istanbul|jshint|global|prettier).*\*/)\s*$", re.I)


def body_end(text: str, start: int, language: str) -> int:
    """Where the function that starts at ``start`` ends (offset); the end of the text where it is cut."""
    if language == "python":
        lines = text[start:].split("\n")
        indent = len(lines[0]) - len(lines[0].lstrip())
        size = len(lines[0]) + 1
        for s in lines[1:]:
            if s.strip() and len(s) - len(s.lstrip()) <= indent:
                break
            size += len(s) + 1
        return min(len(text), start + size)
    if language in ("lua", "ruby"):
        stack = 0
        loop = False
        for m in _ENDS.finditer(text, start):
            w = m.group(0)
            if w in ("while", "for"):
                loop = True
                stack += 1
            elif w == "do":
                stack += 0 if loop else 1
                loop = False
            elif w in ("function", "if", "repeat", "def", "class", "module", "begin", "case", "unless"):
                stack += 1
            elif w in ("end", "until"):
                stack -= 1
                if stack <= 0:
                    return m.end()
        return len(text)
    stack: list[str] = []
    arrow = False
    for m in (_SCRIPT_BRACES if language == "typescript" else _BRACES).finditer(text, start):
        w = m.group(0)
        if w in _OPENING:
            stack.append(w)
        elif w in _CLOSING:
            # An unmatched mark belongs to what the function stands in.
            if not stack:
                return m.start()
            while stack and stack.pop() != _CLOSING[w]:
                pass
            if not stack and w == "}" and not _GOES_ON.match(text, m.end()):
                return m.end()
        elif stack:
            continue
        elif w == ";":
            return m.end()
        elif w == "=>":
            arrow = _BODY_BRACE.match(text, m.end()) is None
        elif w == "\n" and arrow and not _NEXT_LINE.match(text, m.end()) and not _OPEN_LINE.search(text, max(start, m.start() - 16), m.start()):
            return m.start()
    return len(text)


_OPENING, _CLOSING = frozenset("([{"), {")": "(", "]": "[", "}": "{"}
#: Behind a closing brace: a type that goes on, or the body of a function whose type was in braces.
_GOES_ON = re.compile(r"[ \t]*(?:\{|[>|&]|=>|\[\])")
_BODY_BRACE = re.compile(r"\s*\{")
#: An expression without braces goes on over a line break before or behind these.
_NEXT_LINE = re.compile(r"\s*(?:[.?:+*/%&|,=<>)\]}-]|&&|\|\||instanceof\b|in\b|as\b)")
_OPEN_LINE = re.compile(r"(?:[.?:+*/%&|,=<>(\[{-]|=>)[ \t]*\Z")


def comment_above(lines: list[str], at: int, language: str) -> str | None:
    """The documentation comment that ends at most GAP blank lines above line ``at``; lint and attribute lines are passed
    over on either side of it."""
    i, blank = at - 1, 0
    while i >= 0 and (_SKIP_LINE.match(lines[i]) or not lines[i].strip()):
        if not lines[i].strip():
            blank += 1
            if blank > GAP:
                return None
        i -= 1
    if i < 0:
        return None
    marks = _DOC_LINE[language]
    last = i
    s = lines[i].strip()
    if s.endswith("*/") or s.endswith("]]"):
        opener = "/*" if s.endswith("*/") else "--[["
        while i >= 0 and not lines[i].lstrip().startswith(opener):
            i -= 1
        if i < 0 or not lines[i].lstrip().startswith(marks):
            return None
        return "\n".join(lines[i : last + 1])
    line_marks = tuple(m for m in marks if m not in ("/**", "/*!", "--[["))
    while i >= 0 and line_marks and lines[i].lstrip().startswith(line_marks):
        i -= 1
    return "\n".join(lines[i + 1 : last + 1]) if i < last else None


def functions(text: str, language: str, first: bool = False) -> list[tuple[str, int, int, str | None]]:
    """(name, start, end, documentation comment) of each function of a text in text order; nested ones included. ``first``:
    no more than one."""
    rx = SIGNATURES.get(language)
    if rx is None:
        return []
    lines = text.split("\n")
    out = []
    for m in rx.finditer(text):
        start = m.start() + len(m.group(0)) - len(m.group(0).lstrip())
        doc = comment_above(lines, text.count("\n", 0, start), language)
        out.append((next(g for g in m.groups() if g), start, body_end(text, start, language), doc))
        if first:
            break
    return out


#: What stands in for documentation without being any, in the languages met; compared as whole units.
PLACEHOLDERS = frozenset(
    (
        "todo|fixme|xxx|tbd|tba|wip|hack|n/a|na|none|null|nil|empty|placeholder|undocumented|documentation|description|docs|doc|comment|stub|"
        "no description|no documentation|no docs|not documented|not yet documented|to be documented|to be done|to do|to be written|description here|documentation here|add description|add documentation|missing documentation|write me|fill me in|coming soon|see code|self explanatory|"
        "auto-generated method stub|auto-generated stub|autogenerated stub|auto generated|sin documentar|sin descripción|sin documentación|por documentar|pendiente|noch zu beschreiben|noch zu dokumentieren|keine beschreibung|nicht dokumentiert|undokumentiert|"
        "à documenter plus tard|à documenter|à compléter|pas de description|non documenté|sans documentation|nog te documenteren|geen beschrijving|niet gedocumenteerd|lorem ipsum"
    ).split("|")
)
_MARKS = re.compile(r"^\s*(?:<!--|-->|/\*[*!]*|\*+/|\*+(?!\w)|///?!?|//!|--\[=*\[|\]=*\]|-{2,}|#+(?=\s|$)|>+|[-=~*_#.·]{2,}$)\s*|\s*(?:\*+/|-->|\]\])\s*$")
_TAG = re.compile(r"^\s*(?:\{@(\w+)[^}]*\}|[@\\](\w+)\b)\s*(.*)$", re.S)
_LINT = re.compile(r"^(?:eslint|prettier|tslint|jshint|jscs|noqa|nolint|luacheck|selene|stylua|clang-format|istanbul|c8|biome|rustfmt|noinspection|cspell|@ts-|#?(?:end)?region\b|pragma\b|pylint|rubocop|type:\s*ignore|allow\(|sourcery|sonar|coverage:)", re.I)
_TASK = re.compile(r"^(?:todo|fixme|xxx|hack|tbd|wip)\b", re.I)
_POINTER = re.compile(
    r"^(?:see(?: also)?|cf\.?|refer to|please refer|moved (?:from|to|here)|documented (?:in|at|elsewhere)|for (?:more|details|everything|further)|more (?:info|details|information)|inherits? (?:doc|from)|same as (?:above|below)|as above|ditto|siehe(?: auch)?|vgl\.?|voir(?: aussi)?|véase|ver también|zie(?: ook)?|described (?:in|elsewhere)|details (?:in|are)|copied from|https?://)\b",
    re.I,
)
_NOTICE = re.compile(r"\bcopyright\b|©|\(c\)\s*\d{4}|\blicen[cs]e[ds]?\b|provided [\"']?as[- ]is|all rights reserved|\bspdx\b|^\W*(?:owner|owned by|author|authors|maintainer|maintainers|maintained by|written by|created by|reviewed by|reviewer|contact|team|ticket|since|version|date|history|changelog|lizenz|eigentümer|auteur|autor|propriétaire|propietario)\s*[:=]|\bsee (?:the )?licen[cs]e", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_HUMPS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
#: Words that carry nothing beside the function's own name, and tags whose text is no documentation.
FILLERS = frozenset(
    "a an the this that these it its is are be was to of in on for and or with by as at from function functions func fn method methods helper helpers procedure routine subroutine callback handler getter setter accessor constructor utility util "
    "called named name implementation implements definition defines class module object value values return returns returned result results param params parameter parameters argument arguments arg args lives file here there please document documented documenting when time "
    "does do not yet just simply basically code der die das den dem ein eine einen einer funktion methode hilfsfunktion ist le la les un une des du de fonction méthode est el los las una función método es del functie deze".split()
)
_EMPTY_TAGS = frozenset("see link inheritdoc inheritDoc internal deprecated private public protected static async ignore hidden override overload readonly abstract final virtual since version author license copyright file module namespace memberof name function method class interface kind type typedef category group todo fixme region endregion region_ test export local nodiscard".split())


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ings", "ing", "ies", "ied", "es", "ed", "s", "e"):
        if len(w) > len(end) + 2 and w.endswith(end):
            return w[: -len(end)]
    return w


def name_stems(name: str | None) -> frozenset[str]:
    return frozenset(_stem(x) for x in _HUMPS.findall(name or ""))


def _carries(text: str, own: frozenset[str]) -> bool:
    """Are words left beside fillers and the function's own name?"""
    if sum(len(w) for w in re.findall(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+", text)) >= 4:
        return True
    words = [x for w in _WORDS.findall(text) for x in (_HUMPS.findall(w) or [w])]
    left = [w for w in words if w.lower() not in FILLERS and _stem(w) not in own and not w.isdigit()]
    if not left:
        return False
    # A single word left beside the name is a paraphrase unless it stands in a phrase of its own.
    return len(left) >= 2 or len(words) >= 2 and not any(_stem(w) in own for w in words)


def says_something(text: str | None, name: str | None) -> bool:
    """Does a documentation text tell anything about behaviour, use, result or limits?"""
    if text is None or not text.strip():
        return False
    own = name_stems(name)
    units: list[str] = []
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        heading = False
        for _ in range(4):
            m = _MARKS.search(line)
            if not m or not m.group(0):
                break
            heading = heading or m.group(0).strip().startswith("#")
            line = line[: m.start()] + line[m.end() :]
        line = line.strip()
        if not line or heading:
            units.append("")
            continue
        if units and units[-1] and not _TAG.match(line) and units[-1][-1] not in ".!?:" and not _TAG.match(units[-1]) and units[-1].lower() not in PLACEHOLDERS:
            units[-1] += " " + line
        else:
            units.append(line)
    for unit in units:
        tag = _TAG.match(unit)
        if tag and unit[:2] != "{@" or tag and tag.group(1):
            kind, rest = (tag.group(1) or tag.group(2)), tag.group(3)
            if kind in _EMPTY_TAGS or kind.lower() in _EMPTY_TAGS:
                if kind.lower() not in ("deprecated",) or not _carries(rest, own):
                    continue
            if kind.lower() in ("param", "arg", "argument", "tparam", "prop", "property", "field", "throws", "exception"):
                rest = re.sub(r"^\s*(?:\{[^}]*\}|\[[^\]]*\])?\s*", "", rest)
                head, _, tail = rest.partition(" ")
                if tail and _carries(tail.lstrip("- :"), own | name_stems(head)) and len(_WORDS.findall(tail)) >= 3:
                    return True
                continue
            if _carries(rest, own) and len(_WORDS.findall(rest)) >= 3:
                return True
            continue
        for s in _SENTENCE.split(unit):
            bare = s.strip().strip("`\"'()[]{}<>*_-=#.:!?,; ").lower()
            if not bare or bare in PLACEHOLDERS or _LINT.match(s.strip().lstrip("/-#* ")) or _TASK.match(bare) or _POINTER.match(s.strip("`\"'([{<*_- ")) or _NOTICE.search(s):
                continue
            if re.search(r"\bplease (?:refer|document|see)\b|\brefer to the\b|\bsee (?:the|also)\b.*\b(?:documentation|docs|wiki|page|notes|manual|readme|guide)\b", s, re.I):
                continue
            if not any(c.isalnum() for c in s):
                continue
            if _carries(s, own):
                return True
    return False


def last_segment(fqdn: str | None) -> str | None:
    return None if fqdn is None else fqdn.rsplit("::", 1)[-1].rsplit(".", 1)[-1].rsplit(":", 1)[-1]


def documented_bodies(bodies: DataFrame, with_code: bool) -> DataFrame:
    """workspace_id, fqdn, good (the comment that opens the body says something), size (of the delimited function), doc and, on
    request, code: one row per stored non-blank body. Narrow.

    The function is the first signature's, from its line to the end of its body; a body without a signature is taken whole.
    """
    spark = ship(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, sizes, docs, codes = [], [], [], []
            for fqdn, file, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                language = BY_EXTENSION.get((file or "").rsplit(".", 1)[-1].lower(), "typescript")
                found = functions(body, language, first=True)
                doc = found[0][3] if found else None
                good.append(says_something(doc, last_segment(fqdn)))
                docs.append(doc)
                codes.append(body[found[0][1] : found[0][2]] if found else body)
                sizes.append(len(codes[-1].strip()))
            cols = [b.column(0), b.column(1), pa.array(good, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(docs, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(codes, pa.string())] if with_code else cols, ["workspace_id", "fqdn", "good", "size", "doc", *(["code"] if with_code else [])])

    d = bodies.where("fqdn is not null and body rlike '\\\\S'").select("workspace_id", "fqdn", "file", "body")
    d = spread(d, "workspace_id", "fqdn")
    return d.mapInArrow(run, "workspace_id string, fqdn string, good boolean, size int, doc string" + (", code string" if with_code else ""))


def telling_documents(documents: DataFrame) -> DataFrame:
    """workspace_id, fqdn, text of the rows whose text says something."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [says_something(t, last_segment(f)) for f, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield b.filter(pa.array(keep, pa.bool_()))

    d = documents.where("symbol_fqdn is not null and description rlike '\\\\S'").select("workspace_id", F.col("symbol_fqdn").alias("fqdn"), F.col("description").alias("text"))
    return d.mapInArrow(run, "workspace_id string, fqdn string, text string")


def _callables(symbols: DataFrame) -> DataFrame:
    return symbols.where("kind = 'callable' and fqdn is not null").select("workspace_id", "fqdn").distinct()


def documented(bodies: DataFrame, symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """workspace_id, fqdn of each callable with a body and documentation that says something. Only keys and flags are
    shuffled; keys fold map-side before they meet."""
    body = documented_bodies(bodies, with_code=False).where("size > 0").groupBy("workspace_id", "fqdn").agg(F.max("good").alias("good"))
    told = telling_documents(documents).select("workspace_id", "fqdn").distinct().withColumn("told", F.lit(True))
    both = body.join(told, ["workspace_id", "fqdn"], "left").where("good or told")
    return both.join(_callables(symbols), ["workspace_id", "fqdn"], "left_semi").select("workspace_id", "fqdn")


def pairs(bodies: DataFrame, symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """workspace_id, fqdn, code, description, from_body: one pair per documented callable.

    Code is the function without the comment above it. The comment in the body wins over the table; among several texts of
    the table the least by (length, text) descending, so that a run repeats itself.
    """
    b = documented_bodies(bodies, with_code=True).where("size > 0").groupBy("workspace_id", "fqdn").agg(F.max_by(F.struct("good", "doc", "code"), F.struct("good", F.length("code"), "code")).alias("b"))
    t = telling_documents(documents).groupBy("workspace_id", "fqdn").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    j = b.join(t, ["workspace_id", "fqdn"], "left").where("b.good or text is not null").join(_callables(symbols), ["workspace_id", "fqdn"], "left_semi")
    return j.select("workspace_id", "fqdn", "b.code", F.when(F.col("b.good"), F.col("b.doc")).otherwise(F.col("text")).alias("description"), F.col("b.good").alias("from_body"))
