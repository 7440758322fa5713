"""Token streams of whole source texts: (types, line break before it?, offset) per token; ``ERR`` ends a text that can't be
cut into tokens. Comments and white space are no tokens."""

from __future__ import annotations

import re

Tokens = tuple[list[str], list[bool], list[int]]

#: Reserved words of the languages.
RUST_WORDS = frozenset("as async await box break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type union unsafe use where while auto default macro_rules macro raw safe".split())
C_WORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while "
    "_Alignas _Alignof _Atomic _Bool _Complex _Generic _Noreturn _Static_assert _Thread_local bool alignas alignof static_assert thread_local constexpr typeof __typeof__ __attribute__ __declspec __extension__ "
    "asm __asm__ __asm __volatile__ __inline __inline__ __restrict __restrict__ __const __int128 _Float16".split()
)
LUA_WORDS = frozenset("and break do else elseif end false for function goto if in local nil not or repeat return then true until while".split())
JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with "
    "async of get set static from as type interface declare namespace module abstract readonly satisfies is keyof infer unique asserts implements private protected public override accessor global out require using defer source assert await yield let package any number string boolean never unknown object symbol bigint undefined target meta".split()
)

#: Blanks and line comments before a token, taken in one go and never given back.
_SKIP_RUST, _SKIP_C, _SKIP_LUA = r"(?:\s++|//[^\n]*+)*+", r"(?:[ \t\r\f\v]++|\\\r?\n|//(?:[^\n\\]|\\\r?\n|\\.)*+|/\*(?:[^*]|\*(?!/))*+\*/|\n)*+", r"\s*+"
_SKIP_JS = r"(?:[^\S\n\u2028\u2029]++|//[^\n\u2028\u2029]*+)*+"

_RUST = re.compile(
    _SKIP_RUST + r"(?:(?P<BC>/\*)|(?P<RAW>(?:br|cr|r)(#*)\")|(?P<STR>(?:b|c)?\"(?:[^\"\\]|\\.)*\")|(?P<BADSTR>(?:b|c)?\")|"
    r"(?P<CHAR>b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))')|(?P<LIFETIME>'[^\W\d]\w*)|(?P<RID>r#[^\W\d]\w*)|"
    r"(?P<NUM>0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0o[0-7_]+\w*|0b[01_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?(?:[eE][+-]?[\d_]+)?(?:[a-z]\w*)?)|(?P<ID>[^\W\d]\w*)|"
    r"(?P<OP>\.\.\.|\.\.=|<<=|>=|::|->|=>|==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|&&|\|\||<<|\.\.|[-+*/%^!&|=<>@.,;:#$?~(){}\[\]]))", re.S)

_C = re.compile(
    _SKIP_C + r"(?:(?P<BADC>/\*)|(?P<STR>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\")|(?P<CHAR>[uUL]?'(?:[^'\\\n]|\\.)+')|(?P<BAD>[\"'])|"
    r"(?P<NUM>0[xX][0-9a-fA-F]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01]+[uUlL]*|(?:\d[\d']*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[uUlLfFdD]*(?![\w.]))|(?P<ID>[^\W\d]\w*)|"
    r"(?P<OP>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\^=|\|=|[-+*/%=<>!~&|^?:;,.(){}\[\]#]))", re.S)

_LUA = re.compile(
    _SKIP_LUA + r"(?:(?P<LC>--\[(=*)\[)|(?P<CM>--[^\n]*)|(?P<LS>\[(=*)\[)|(?P<STR>\"(?:[^\"\\\n]|\\(?:z\s*|\r\n|.))*\"|'(?:[^'\\\n]|\\(?:z\s*|\r\n|.))*')|(?P<BAD>[\"'])|"
    r"(?P<NUM>0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?\d+)?(?:ULL|LL|i)?|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:ULL|LL|i)?(?![\w]))|(?P<ID>[A-Za-z_]\w*)|"
    r"(?P<OP>\.\.\.|\.\.|==|~=|<=|>=|<<|>>|//|::|[-+*/%^#&|~<>=(){}\[\];:,.]))", re.S)

_JS = re.compile(
    _SKIP_JS + r"(?:(?P<NL>[\n\u2028\u2029]\s*+)|(?P<BC>/\*.*?\*/)|(?P<BADC>/\*)|(?P<STR>\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')|(?P<BAD>[\"'])|"
    r"(?P<NUM>0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$]))|(?P<ID>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|\u200c|\u200d|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)|(?P<PRIV>#[^\W\d][\w$]*)|(?P<TPL>`)|"
    r"(?P<OP>\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\?\.(?!\d)|\?\?|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]))", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_OPERAND = frozenset("IDENT NUM STR TPL TPLE REGEX PRIVATE JSXE ) ] } this super null true false ++ --".split())
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_SPACE = re.compile(r"(?:\s+|/\*.*?\*/|//[^\n]*)+", re.S)


def _stuck(s: str, i: int, skip: re.Pattern) -> int:
    """Where a text that no token matches at ``i`` goes on; its length where only blanks and comments are left."""
    return skip.match(s, i).end()


_AFTER_RUST, _AFTER_C, _AFTER_LUA, _AFTER_JS = (re.compile(x, re.S) for x in (_SKIP_RUST, _SKIP_C, _SKIP_LUA, _SKIP_JS))


def lex_rust(s: str) -> Tokens:
    """Tokens of a Rust text; its grammar knows no line breaks, so none are told."""
    t, o = [], []
    i, n = 0, len(s)
    if s.startswith("\ufeff"):
        i = 1
    if s.startswith("#!", i) and not s.startswith("#![", i):
        i = s.find("\n", i) if "\n" in s else n
    match, kind_of, at_of = _RUST.match, t.append, o.append
    while True:
        m = match(s, i)
        if m is None:
            i = _stuck(s, i, _AFTER_RUST)
            if i < n:
                kind_of("ERR")
                at_of(i)
            break
        k = m.lastgroup
        at = m.start(k)
        if k == "OP":
            kind_of(m[k])
            at_of(at)
            i = m.end()
            continue
        if k == "ID":
            w = m[k]
            kind_of(w if w in RUST_WORDS or w == "_" else "IDENT")
            at_of(at)
            i = m.end()
            continue
        i = m.end()
        if k == "BC":
            depth = 1
            while depth:
                a, z = s.find("/*", i), s.find("*/", i)
                if z < 0:
                    return [*t, "ERR"], [False] * (len(t) + 1), [*o, at]
                depth, i = (depth + 1, a + 2) if 0 <= a < z else (depth - 1, z + 2)
            continue
        if m.group("RAW"):
            close = '"' + m.group("RAW").lstrip("bcr")[:-1]
            at = m.start("RAW")
            i = s.find(close, i)
            if i < 0:
                return [*t, "ERR"], [False] * (len(t) + 1), [*o, at]
            k, i = "STR", i + len(close)
        elif k == "BADSTR":
            return [*t, "ERR"], [False] * (len(t) + 1), [*o, at]
        elif k == "RID":
            k = "IDENT"
        kind_of(k)
        at_of(at)
    return t, [False] * len(t), o


def _directives(s: str, pick: tuple[int, ...] = (), seen: set[tuple[int, ...]] | None = None) -> tuple[str, bool]:
    """C text without its preprocessing lines and, of each conditional, all groups but one. False when the conditionals
    don't close.

    ``pick`` numbers the group kept at each depth of nesting (the first beyond its end); where there are fewer groups, the
    last one is kept. A group under ``#if 0`` is never kept. ``seen`` collects the numbers of all groups met, outer first.
    """
    if "#" not in s:
        return s, True
    out: list[str] = []
    lines = s.split("\n")
    # First the number of groups of each conditional, so that picks beyond the last one can be told.
    sizes: list[int] = []
    for final in (False, True):
        stack: list[list] = []  # [kept?, number of this group, groups that count, which conditional]
        i, comment, nth = 0, False, 0
        while i < len(lines):
            line = lines[i]
            m = None if comment else re.match(r"\s*#\s*(\w*)\s*(.*)", line)
            if m:
                whole, first = line, i
                while whole.rstrip("\r").endswith("\\") and i + 1 < len(lines):
                    i += 1
                    whole = lines[i]
                word, cond = m.group(1), m.group(2).strip()
                if word in ("if", "ifdef", "ifndef"):
                    off = word == "if" and re.fullmatch(r"(?:0|false)\s*(?:/[/*].*)?", cond) is not None
                    if not final:
                        sizes.append(0 if off else 1)
                        stack.append([True, 0, 0, len(sizes) - 1])
                    else:
                        want = min(pick[len(stack)] if len(stack) < len(pick) else 0, sizes[nth] - 1)
                        at = -1 if off else 0
                        stack.append([at == want, at, want, nth])
                    nth += 1
                elif word in ("elif", "else", "elifdef", "elifndef"):
                    if not stack:
                        return s, False
                    if not final:
                        sizes[stack[-1][3]] += 1
                    else:
                        stack[-1][1] += 1
                        stack[-1][0] = stack[-1][1] == stack[-1][2]
                elif word == "endif":
                    if not stack:
                        return s, False
                    stack.pop()
                if final and seen is not None and word not in ("endif",) and stack and stack[-1][1] >= 0:
                    seen.add(tuple(max(x[1], 0) for x in stack))
                rest = re.sub(r"\"(?:\\.|[^\"\\])*\"|//.*", "", line)
                at = rest.rfind("/*")
                if at >= 0 and "*/" not in rest[at:]:
                    comment = True
                if final:
                    out += [" " * len(x) for x in lines[first : i + 1]]
            else:
                bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', line) if not comment else line
                pos = 0
                while True:
                    if comment:
                        z = bare.find("*/", pos)
                        if z < 0:
                            break
                        comment, pos = False, z + 2
                    else:
                        a, c = bare.find("/*", pos), bare.find("//", pos)
                        if a < 0 or 0 <= c < a:
                            break
                        comment, pos = True, a + 2
                if final:
                    out.append(line if all(x[0] for x in stack) else " " * len(line))
            i += 1
    return "\n".join(out), not stack


def c_picks(s: str) -> list[tuple[int, ...]]:
    """The picks under which every group of every conditional of a C text is kept at least once; ``()`` is among them."""
    seen: set[tuple[int, ...]] = set()
    if "#el" in s.replace(" ", "").replace("\t", ""):
        _directives(s, seen=seen)
    picks = [p for p in sorted(seen) if any(p) and not any(q != p and q[: len(p)] == p for q in seen)]
    return [(), *picks]


def lex_c(s: str, pick: tuple[int, ...] = ()) -> Tokens:
    """Tokens of a C text with the groups of ``pick`` (see :func:`_directives`), else the first of each conditional."""
    t, o = [], []
    s = " " + s[1:] if s.startswith("\ufeff") else s
    s, closed = _directives(s, pick)
    i, n, match = 0, len(s), _C.match
    while m := match(s, i):
        k = m.lastgroup
        w = m[k]
        if k == "BADC" or k == "BAD" or w == "#":
            t.append("ERR")
            o.append(m.start(k))
            return t, [False] * len(t), o
        t.append(w if k == "OP" else (w if w in C_WORDS else "IDENT") if k == "ID" else k)
        o.append(m.start(k))
        i = m.end()
    i = _stuck(s, i, _AFTER_C)
    if i < n or not closed:
        t.append("ERR")
        o.append(i)
    return t, [False] * len(t), o


def lex_lua(s: str) -> Tokens:
    """Tokens of a Lua text; its grammar knows no line breaks, so none are told."""
    t, o = [], []
    i, n = 0, len(s)
    if s.startswith("\ufeff"):
        i = 1
    if s.startswith("#", i):
        i = s.find("\n", i) if "\n" in s else n
    match = _LUA.match
    while m := match(s, i):
        k = m.lastgroup
        i = m.end()
        long = m.group("LC") or m.group("LS")
        if long:
            at = m.start("LC") if m.group("LC") else m.start("LS")
            close = "]" + "=" * long.count("=") + "]"
            z = s.find(close, i)
            if z < 0:
                i = at
                break
            i = z + len(close)
            if m.group("LS"):
                t.append("STR")
                o.append(at)
            continue
        if k == "CM":
            continue
        w = m[k]
        if k == "BAD":
            i = m.start(k)
            break
        t.append(w if k == "OP" else (w if w in LUA_WORDS else "IDENT") if k == "ID" else k)
        o.append(m.start(k))
    i = _stuck(s, i, _AFTER_LUA)
    if i < n:
        t.append("ERR")
        o.append(i)
    return t, [False] * len(t), o


class Script:
    """ECMAScript needs to know what came before: a slash divides after an operand and opens a pattern elsewhere."""

    def __init__(self, s: str, jsx: bool):
        self.s, self.jsx = s, jsx
        self.t: list[str] = []
        self.b: list[bool] = []
        self.o: list[int] = []
        self.nl = False

    def put(self, kind: str, at: int) -> None:
        self.t.append(kind)
        self.b.append(self.nl)
        self.o.append(at)
        self.nl = False

    def run(self, i: int, nested: bool) -> int:
        """Tokens from ``i`` to the end, or, nested, to the brace that closes the embedding; -1 after an error."""
        s, n, match = self.s, len(self.s), _JS.match
        t = self.t
        depth = 0
        parens: list[bool] = []
        closed_if = False
        while i < n:
            m = match(s, i)
            k = m.lastgroup if m else None
            if k == "NL":
                self.nl, i = True, m.end()
                continue
            if k == "BC":
                self.nl, i = self.nl or "\n" in m["BC"], m.end()
                continue
            i = m.start(k) if m else _stuck(s, i, _AFTER_JS)
            if i >= n:
                break
            if m is None or k in ("BADC", "BAD"):
                self.put("ERR", i)
                return -1
            prev = t[-1] if t else ""
            operand = prev in _OPERAND or (prev in JS_WORDS and prev not in _BEFORE_OPERAND)
            if prev == ")" and closed_if or prev == "}" and s[i] == "/":
                operand = False
            w = m[k]
            if s[i] == "/" and not operand:
                r = _REGEX.match(s, i)
                if r is None:
                    self.put("ERR", i)
                    return -1
                self.put("REGEX", i)
                i = r.end()
                continue
            if w in ("<", "<<", "<=") and w == "<" and self.jsx and not operand and re.match(r"<(?:>|[A-Za-z_$])", s[i : i + 2]) and not re.match(r"<\w+\s*(?:,|extends\b)", s[i : i + 80]):
                i = self.element(i)
                if i < 0:
                    return -1
                continue
            if k == "ID":
                self.put(w if w in JS_WORDS and prev != "." and prev != "?." else "IDENT", i)
            elif k == "PRIV":
                self.put("PRIVATE", i)
            elif k == "TPL":
                i = self.template(i)
                if i < 0:
                    return -1
                continue
            elif k == "OP":
                if w == "(":
                    parens.append(prev in ("if", "while", "for", "with"))
                elif w == ")":
                    closed_if = parens.pop() if parens else False
                elif w == "{":
                    depth += 1
                elif w == "}":
                    if nested and depth == 0:
                        return i
                    depth -= 1
                self.put(w, i)
            else:
                self.put(k, i)
            i = m.end()
        if nested:
            self.put("ERR", n)
            return -1
        return n

    def template(self, i: int) -> int:
        s, start, first, n = self.s, i, True, len(self.s)
        i += 1
        while i < n:
            c = s[i]
            if c == "\\":
                i += 2
            elif c == "`":
                self.put("TPL" if first else "TPLE", start)
                return i + 1
            elif c == "$" and s.startswith("${", i):
                self.put("TPLB" if first else "TPLM", start)
                first = False
                i = self.run(i + 2, True)
                if i < 0:
                    return -1
                start = i
                i += 1
            else:
                nxt = _TPL_STOP.search(s, i + 1)
                i = nxt.start() if nxt else n
        self.put("ERR", min(start, n))
        return -1

    def element(self, i: int) -> int:
        """An element from its ``<`` on: JSXB, embedded expressions as ``{ ... }``, JSXE."""
        s, n = self.s, len(self.s)

        def bad(at: int) -> int:
            self.put("ERR", min(at, n))
            return -1

        def space(j: int) -> int:
            m = _JSX_SPACE.match(s, j)
            return m.end() if m else j

        def embed(j: int) -> int:
            self.put("{", j)
            j = self.run(j + 1, True)
            if j < 0:
                return -1
            self.put("}", j)
            return j + 1

        self.put("JSXB", i)
        j = space(i + 1)
        m = _JSX_NAME.match(s, j)
        name = m.group() if m else ""
        j = space(m.end() if m else j)
        if name:
            while j < n and s[j] not in "/>":
                if s[j] == "{":
                    j = embed(j)
                    if j < 0:
                        return -1
                else:
                    m = _JSX_NAME.match(s, j)
                    if not m:
                        return bad(j)
                    j = space(m.end())
                    if j < n and s[j] == "=":
                        j = space(j + 1)
                        if j < n and s[j] in "\"'":
                            z = s.find(s[j], j + 1)
                            if z < 0:
                                return bad(j)
                            j = z + 1
                        elif j < n and s[j] == "{":
                            j = embed(j)
                            if j < 0:
                                return -1
                        elif j < n and s[j] == "<":
                            j = self.element(j)
                            if j < 0:
                                return -1
                        else:
                            return bad(j)
                j = space(j)
            if s.startswith("/>", j):
                self.put("JSXE", j)
                return j + 2
        if j >= n or s[j] != ">":
            return bad(j)
        j += 1
        while j < n:
            if s[j] == "{":
                j = embed(j)
                if j < 0:
                    return -1
            elif s.startswith("</", j):
                k = space(j + 2)
                m = _JSX_NAME.match(s, k)
                close = m.group() if m else ""
                k = space(m.end() if m else k)
                if close != name or not s.startswith(">", k):
                    return bad(j)
                self.put("JSXE", j)
                return k + 1
            elif s[j] == "<":
                j = self.element(j)
                if j < 0:
                    return -1
            elif s[j] in ">}":
                return bad(j)
            else:
                j += 1
        return bad(n)


_TPL_STOP = re.compile(r"[\\`$]")
#: Words after which a slash opens a pattern and ``<`` an element.
_BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends const let var import export".split())


def lex_script(s: str, jsx: bool) -> Tokens:
    p = Script(s, jsx)
    i = 1 if s.startswith("\ufeff") else 0
    if s.startswith("#!", i):
        i = s.find("\n", i) if "\n" in s else len(s)
    p.run(i, False)
    return p.t, p.b, p.o
