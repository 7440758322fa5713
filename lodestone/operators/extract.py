"""Extraction of the graph from source texts: symbols, imports, calls, type uses, documentation, foreign-function marks.

One pass of Arrow batches over files; each file is cut into tokens (``functions.lexers``) and walked with a stack of scopes.
Everything a file yields comes out as rows of one table, told apart by ``what``:

``symbol`` name, fqdn, kind, language_kind, module, visibility, receiver_type, target (trait or base), lines
``edge``   fqdn (source), kind (CALLS, IMPORTS, EXTENDS, IMPLEMENTS, USES_TYPE, REFERENCES), target, receiver_type, attribute
``call``   fqdn (source), target (text as written), lines, attribute (all arguments as one text), args (one by one)
``doc``    fqdn, target (text)
``ffi``    fqdn, kind (import or export), target (name at the boundary), attribute (abi)

Receiver types are known where the source writes them (``self``, typed parameters, ``let x: T``, ``let x = T::new()``);
return types of other functions come from :func:`return_types`, a first pass over all files. Texts that can't be cut into
tokens yield their module row and what stands before the fault. Null contents yield nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.functions.lexers import lex_c, lex_lua, lex_rust, lex_script
from lodestone.functions.text import nominal_head
from lodestone.session import ship

SCHEMA = (
    "path string, what string, name string, fqdn string, kind string, language_kind string, module string, visibility string, receiver_type string, "
    "target string, attribute string, start_line int, end_line int, entry_point string, body_hash string, args array<struct<value:string,is_string_literal:boolean>>"
)
_COLS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Derives and the traits they stand for (traits without methods give no edge); wrappers that are transparent for method calls.
DERIVES = {d: d for d in ("Clone", "Debug", "Default", "Deserialize", "Hash", "Ord", "PartialEq", "PartialOrd", "Serialize")}
TRANSPARENT = frozenset(("Arc", "Rc", "Box"))
#: Names of the language's own objects, which no REFERENCES edge leads to.
JS_GLOBALS = frozenset("console window document globalThis self undefined NaN Infinity Math Date Object Array Number String Boolean JSON RegExp Symbol Error TypeError RangeError Map Set WeakMap WeakSet Promise Proxy Reflect parseInt parseFloat isNaN isFinite encodeURI encodeURIComponent decodeURI decodeURIComponent".split())
_SKIP_CALLS = frozenset("if while for switch match return sizeof function catch typeof await elseif until and or not".split())


_SCRIPT_VALUES = re.compile(r"(?m)^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=(?!\s*(?:async\b|function\b|\())")
_VALUES = {"rust": re.compile(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?([A-Z_]\w*)\s*:"), "typescript": _SCRIPT_VALUES, "javascript": _SCRIPT_VALUES, "vue": _SCRIPT_VALUES, "svelte": _SCRIPT_VALUES}


class _File:
    def __init__(self, path: str, text: str, language: str, module: str, returns: dict[str, str]):
        self.path, self.text, self.language, self.module, self.returns = path, text, language, module, returns
        self.rows: list[dict] = []
        #: Names of the file's own constants and variables, whose reads are references.
        self.values = frozenset(_VALUES[language].findall(text)) if language in _VALUES else frozenset()
        self.starts = [0]
        for m in re.finditer("\n", text):
            self.starts.append(m.end())

    def line(self, offset: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, offset)

    def put(self, what: str, **kw) -> None:
        self.rows.append({"path": self.path, "what": what, **kw})

    def symbol(self, name: str, kind: str, language_kind: str, owner: str, start: int, end: int, **kw) -> str:
        import hashlib

        fqdn = f"{owner}::{name}" if owner else name
        body = self.text[start:end]
        self.put("symbol", name=name, fqdn=fqdn, kind=kind, language_kind=language_kind, module=owner or None, start_line=self.line(start), end_line=self.line(max(start, end - 1)), body_hash=hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), **kw)
        doc = self.doc_above(start)
        if doc:
            self.put("doc", fqdn=fqdn, target=doc)
        return fqdn

    def doc_above(self, start: int) -> str | None:
        """Documentation lines right above an offset (attributes between are passed over)."""
        lines = self.text[: self.starts[self.line(start) - 1]].split("\n")[:-1]
        out: list[str] = []
        while lines and re.match(r"\s*(?:#\[.*\]|@\w+.*|//\s*(?:eslint|prettier|NOLINT).*|--\s*luacheck.*)\s*$", lines[-1]):
            lines.pop()
        if lines and lines[-1].rstrip().endswith("*/"):
            while lines:
                s = lines.pop()
                out.append(s)
                if "/*" in s:
                    break
            if not out or "/**" not in out[-1]:
                return None
        else:
            mark = {"lua": "---", "rust": "///"}.get(self.language)
            while mark and lines and lines[-1].lstrip().startswith(mark):
                out.append(lines.pop())
        text = "\n".join(re.sub(r"^\s*(?:/\*\*+|\*+/|\*|///|---)\s?|\s*\*/\s*$", "", s) for s in reversed(out)).strip()
        return text or None


def _closing(t: list[str]) -> dict[int, int]:
    """Index of the closing token for each opening one; unclosed ones end with the text."""
    stack, out = [], {}
    pair = {")": "(", "]": "[", "}": "{"}
    for i, x in enumerate(t):
        if x in ("(", "[", "{"):
            stack.append(i)
        elif x in pair:
            while stack and t[stack[-1]] != pair[x]:
                stack.pop()
            if stack:
                out[stack.pop()] = i
    for i in stack:
        out[i] = len(t) - 1
    return out


def _words(f: _File, lex) -> tuple[list[str], list[str], list[int], dict[int, int]]:
    t, _, o = lex
    ends = [*o[1:], len(f.text)]
    return t, [f.text[a:b].split("\n", 1)[0].strip() if k in ("IDENT",) or k.isalpha() or k.replace("_", "").isalnum() else k for k, a, b in zip(t, o, ends)], o, _closing(t)


def _name(w: str) -> str:
    m = re.match(r"(?:r#)?[\w$#!]+", w)
    return m.group(0).removeprefix("r#") if m else w


_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f_]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r?\n[ \t\r\n]*)|(.))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v", "a": "\a"}


def _literal(text: str, language: str) -> str | None:
    """What a string literal stands for; None for any other text."""
    if language == "rust" and (m := re.fullmatch(r"r(#*)\"(.*)\"\1", text, re.S)) or language == "lua" and (m := re.fullmatch(r"\[(=*)\[\n?(.*)\]\1\]", text, re.S)):
        return m.group(2)
    if len(text) < 2 or text[0] != text[-1] or text[0] not in ("\"" if language in ("rust", "c") else "\"'"):
        return None

    def plain(m: re.Match) -> str:
        code = m.group(1) or m.group(2) or m.group(3)
        if code:
            n = int(code.replace("_", "") or "0", 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else m.group(0)
        if m.group(4) is not None:  # a line that goes on: Rust drops the next one's indent, Lua keeps the break
            return "" if language == "rust" else "\n" + m.group(4).split("\n", 1)[1] if language == "lua" else m.group(4).split("\n", 1)[1]
        return _ESCAPED.get(m.group(5), m.group(5))

    return _ESCAPE.sub(plain, text[1:-1])


def _generics_end(t: list[str], i: int, z: int) -> int:
    """Index of the ``>`` that ends type arguments from the ``<`` at ``i``; 0 if they are none."""
    depth = 0
    while i < z:
        depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(t[i], 0)
        if depth <= 0:
            return i
        if t[i] in (";", "{", "&&", "||", "STR", "NUM"):
            return 0
        i += 1
    return 0


def _arguments(f: _File, t: list[str], o: list[int], close: dict[int, int], a: int, z: int) -> list[dict]:
    """Arguments between the parentheses at ``a`` and ``z``, split at the commas that stand in no bracket, type argument list,
    closure head or template text. String literals come without quotes and escapes."""
    first, i, template = a + 1, a + 1, 0
    out: list[dict] = []

    def put(b: int) -> None:
        if first >= b:
            return
        text = f.text[o[first] : o[b] if b < len(o) else len(f.text)].strip()
        value = _literal(text, f.language) if b == first + 1 else None
        out.append({"value": re.sub(r"\s+", " ", text) if value is None else value, "is_string_literal": value is not None})

    while i < z:
        k = t[i]
        if k == "TPLB":
            template += 1
        elif k == "TPLE":
            template -= 1
        elif k == "|" and f.language == "rust" and (i == first or t[i - 1] in ("move", "async", "=", "=>")):
            i += 1
            while i < z and t[i] != "|":
                i = close.get(i, i) + 1
        elif k == "<" and (i == first or t[i - 1] in ("::", "as", "IDENT")) and f.language in ("rust", "typescript", "vue", "svelte"):
            # Rust writes ``::<`` in expressions; TypeScript takes ``a < b, c > (d)`` for a call with type arguments.
            e = _generics_end(t, i, z) if f.language != "rust" or i == first or t[i - 1] != "IDENT" else 0
            i = e if e and (f.language == "rust" or e + 1 < z and t[e + 1] == "(") else i
        elif k == "function" and f.language == "lua":
            i = min(_lua_end(t, i), z - 1)
        elif k == "," and not template:
            put(i)
            first = i + 1
        i = close.get(i, i) + 1
    put(z)
    return out


def _calls(f: _File, t: list[str], w: list[str], o: list[int], close: dict[int, int], a: int, z: int, source: str, types: dict[str, str], names: dict[str, str] | None = None, module: str | None = None) -> None:
    """Call sites, CALLS edges and value reads between two token indexes. ``names``: what imported names stand for in the
    scope; ``module``: the module it belongs to."""
    names, module = names or {}, f.module if module is None else module
    path_sep = "::" if f.language == "rust" else "."
    i = a
    while i < z:
        if t[i] == "(" and i > a and (t[i - 1] == "IDENT" or t[i - 1] in ("Self", "super", "self", "this") or (f.language == "rust" and t[i - 1] == "!" and i > a + 1 and t[i - 2] == "IDENT")):
            macro = t[i - 1] == "!"
            j = i - (2 if macro else 1)
            chain = [_name(w[j])]
            seps: list[str] = []
            while j - 2 >= a and t[j - 1] in ("::", ".", ":", "->", "?.") and (t[j - 2] == "IDENT" or t[j - 2] in ("self", "Self", "this", "crate", "super")):
                seps.append(t[j - 1])
                chain.append(_name(w[j - 2]))
                j -= 2
            chain.reverse()
            seps.reverse()
            dangling = j - 1 >= a and t[j - 1] in (".", "?.", ":", "->") and len(chain) == 1
            if not (len(chain) == 1 and chain[0] in _SKIP_CALLS) and not (j - 1 >= 0 and t[j - 1] in ("fn", "function")):
                shown = "".join(x + (seps[k] if k < len(seps) else "") for k, x in enumerate(chain)) + ("!" if macro else "")
                end = close.get(i, z)
                f.put("call", fqdn=source, target=shown, start_line=f.line(o[i]), end_line=f.line(o[min(end, len(o) - 1)]), attribute=re.sub(r"\s+", " ", f.text[o[i] + 1 : o[end] if end < len(o) else len(f.text)]), args=_arguments(f, t, o, close, i, min(end, len(t))))
                method = dangling or (seps and seps[-1] in (".", "?.", ":", "->") and path_sep != ".") or (f.language == "rust" and seps and seps[-1] == ".")
                recv = types.get(chain[-2]) if len(chain) > 1 else None
                if macro:
                    f.put("edge", fqdn=source, kind="CALLS", target=chain[-1], attribute="macro", start_line=f.line(o[i]))
                elif method:
                    f.put("edge", fqdn=source, kind="CALLS", target=chain[-1], receiver_type=recv, start_line=f.line(o[i]))
                else:
                    target = path_sep.join(chain) if f.language != "rust" else _target(chain, names, module, types.get("Self"))
                    f.put("edge", fqdn=source, kind="CALLS", target=target, receiver_type=recv, start_line=f.line(o[i]))
        elif t[i] == "IDENT" and t[i - 1] not in (".", "?.", "::", "let", "mut", "const", "fn", "function", "var", "|") and i + 1 < len(t) and t[i + 1] not in ("(", "!", "::", ":", "=>") and not (t[i + 1] == "=" and t[i - 1] in ("{", ";", ",")):
            name = _name(w[i])
            if name in f.values or name in names and f.language != "rust":
                f.put("edge", fqdn=source, kind="REFERENCES", target=names.get(name) or (f"{f.module}::{name}" if f.module else name), attribute="value-read", start_line=f.line(o[i]))
        i += 1


def _target(chain: list[str], names: dict[str, str], module: str, own: str | None) -> str:
    """What the path of a Rust call means: an imported name, a path from crate, self, super or Self, a function of the module."""
    head, rest = chain[0], chain[1:]
    if head in ("crate", "self", "super"):
        return _absolute(chain, module)
    if head == "Self" and own:
        return "::".join(x for x in (module, own, *rest) if x)
    if head in names:
        return "::".join((names[head], *rest))
    return "::".join(chain) if rest or not module else f"{module}::{head}"


def _use_tree(t: list[str], w: list[str], i: int, prefix: list[str], out: list[tuple[list[str], str | None]]) -> int:
    """Leaves of a Rust ``use`` tree: (path, alias)."""
    path = list(prefix)
    while i < len(t):
        if t[i] in ("::",):
            i += 1
        elif t[i] == "{":
            i += 1
            while i < len(t) and t[i] != "}":
                i = _use_tree(t, w, i, path, out)
                if i < len(t) and t[i] == ",":
                    i += 1
            return i + 1
        elif t[i] == "*":
            out.append(([*path, "*"], None))
            return i + 1
        elif t[i] == "as":
            out.append((path[:-1] if path[-1:] == ["self"] and len(path) > 1 else path, _name(w[i + 1]) if i + 1 < len(w) else None))
            return i + 2
        elif t[i] in (",", "}", ";"):
            break
        else:
            path.append(_name(w[i]))
            i += 1
    if path != prefix:
        out.append(([x for x in path if x != "self"] if path[-1] == "self" else path, None))
    return i


def _absolute(path: list[str], module: str) -> str:
    own = module.split("::") if module else []
    if path and path[0] == "crate":
        path = [*own[:1], *path[1:]]
    elif path and path[0] == "self":
        path = [*own, *path[1:]]
    while path and path[0] == "super":
        own = own[:-1]
        path = [*own, *path[1:]] if len(path) < 2 or path[1] != "super" else path[1:]
    return "::".join(path)


def rust(f: _File) -> None:
    t, w, o, close = _words(f, lex_rust(f.text))
    n = len(t)

    def offset(i: int) -> int:
        return o[i] if i < n else len(f.text)

    def variants(a: int, z: int, owner: str, vis: str, generics: set[str]) -> None:
        """Variants between an enum's braces, with the types of their fields."""
        i = a + 1
        while i < z:
            if t[i] == "#" and i + 1 < z and t[i + 1] == "[":
                i = close.get(i + 1, i + 1) + 1
                continue
            e = i + 1
            while e < z and t[e] != ",":
                e = close.get(e, e) + 1
            if t[i] == "IDENT":
                last = close.get(i + 1, i + 1) if i + 1 < z and t[i + 1] in ("(", "{") else i
                stop = offset(last) + 1 if last > i else offset(i) + len(w[i].split("//")[0].split("/*")[0].split(",")[0].split("=")[0].strip())
                fq = f.symbol(_name(w[i]), "type", "enum_variant", owner, offset(i), stop, visibility=vis)
                x = i + 2
                while x < last:
                    if t[x] == "#" and t[x + 1] == "[":
                        x = close.get(x + 1, x + 1)
                    elif t[x] == "IDENT" and _name(w[x])[:1].isupper() and _name(w[x]) not in generics:
                        path = [_name(w[x])]
                        while x + 2 < last and t[x + 1] == "::" and t[x + 2] == "IDENT":
                            path.append(_name(w[x + 2]))
                            x += 2
                        f.put("edge", fqdn=fq, kind="USES_TYPE", target="::".join(path), attribute="type-annotation", start_line=f.line(offset(i)))
                    x += 1
            i = e + 1

    def uses(a: int, z: int, module: str) -> dict[str, str]:
        """What the ``use`` items of a scope bind, the latest last."""
        out: dict[str, str] = {}
        i = a
        while i < z:
            if t[i] == "use":
                leaves: list[tuple[list[str], str | None]] = []
                _use_tree(t, w, i + 1, [], leaves)
                out |= {alias or path[-1]: _absolute(path, module) for path, alias in leaves if path and path[-1] != "*"}
                while i < z and t[i] != ";":
                    i = close.get(i, i) + 1 if t[i] == "{" else i + 1
            i = close.get(i, i) + 1 if i < z else i
        return out

    def walk(a: int, z: int, owner: str, ctx: dict) -> None:
        i, pub, attrs = a, False, []
        if "module" not in ctx:
            # A module sees its own imports only.
            ctx = ctx | {"module": owner, "names": uses(a, z, owner)}
        while i < z:
            k = t[i]
            if k == "#" and i + 1 < z and t[i + 1] in ("[", "!"):
                b = i + 1 if t[i + 1] == "[" else i + 2
                e = close.get(b, b)
                attrs.append(f.text[offset(b) : offset(e) + 1])
                i = e + 1
                continue
            if k == "pub":
                pub = True
                i += 1
                if i < z and t[i] == "(":
                    i = close.get(i, i) + 1
                continue
            vis = "public" if pub else "private"
            start = i
            if k in ("struct", "enum", "union", "trait", "type", "const", "static", "mod", "macro_rules") and i + 1 < z or k == "fn":
                j = i + 1
                while j < z and t[j] in ("mut", "!", "fn"):
                    j += 1
                if k == "const" and t[i + 1] in ("fn", "unsafe", "async") or j >= z or t[j] not in ("IDENT", "_"):
                    i += 1
                    continue
                name = _name(w[j])
                e = j
                while e < z and t[e] not in ("{", ";") and not (t[e] == "=" and k in ("type", "const", "static")):
                    e = close.get(e, e) + 1 if t[e] in ("(", "[") else e + 1
                while e < z and t[e] not in ("{", ";"):
                    e += 1
                end = close.get(e, e) if e < z and t[e] == "{" else e
                stop = offset(end) + 1
                kind = {"fn": "callable", "struct": "type", "enum": "type", "union": "type", "trait": "type", "type": "type", "const": "value", "static": "value", "mod": "module", "macro_rules": "macro"}[k]
                lk = {"fn": "impl_fn" if ctx.get("impl") else "trait_fn" if ctx.get("trait") else "fn", "type": "type_alias", "mod": "module"}.get(k, k)
                fq = f.symbol(name, kind, lk, owner, offset(start), stop, visibility="public" if ctx.get("trait") else vis, receiver_type=ctx.get("impl"), target=ctx.get("of"),
                              entry_point="binary_main" if k == "fn" and name == "main" and owner == f.module and "::" not in owner else "ffi_export" if any("no_mangle" in x for x in attrs) else None)
                if any("no_mangle" in x or "export_name" in x for x in attrs):
                    f.put("ffi", fqdn=fq, kind="export", target=name, attribute="c")
                for x in attrs:
                    m = re.search(r"derive\(([^)]*)\)", x)
                    for d in re.findall(r"\w+", m.group(1)) if m else ():
                        if d in DERIVES:
                            f.put("edge", fqdn=fq, kind="IMPLEMENTS", target=f"<builtin>::rust::{DERIVES[d]}", attribute="derive", start_line=f.line(offset(start)))
                if k == "fn":
                    types = dict(ctx.get("types", {}))
                    if ctx.get("impl"):
                        types["self"] = types["Self"] = ctx["impl"]
                    sig = f.text[offset(j) : offset(e)]
                    for pm in re.finditer(r"(\w+)\s*:\s*([^,()]+(?:\([^()]*\))?)", sig):
                        types[pm.group(1)] = nominal_head(pm.group(2))
                    for tm in re.finditer(r"(?::|->)\s*([^,{]+)", sig):
                        for ty in re.findall(r"\b[A-Z]\w*(?:::\w+)*", tm.group(1)):
                            f.put("edge", fqdn=fq, kind="USES_TYPE", target=ty, attribute="type-annotation", start_line=f.line(offset(start)))
                    if e < z and t[e] == "{":
                        body = f.text[offset(e) : stop]
                        for lm in re.finditer(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*([^=;]+))?=\s*(?:([A-Z]\w*)\s*(?:::\s*\w+\s*\(|\{)|(\w+)\s*\()?", body):
                            ty = lm.group(2) or lm.group(3) or f.returns.get(lm.group(4) or "")
                            if ty:
                                head = nominal_head(ty)
                                types[lm.group(1)] = nominal_head(re.sub(r"^\w+<(.*)>$", r"\1", ty.strip())) if head in TRANSPARENT else head
                        _calls(f, t, w, o, close, e, end, fq, types, ctx["names"] | uses(e + 1, end, ctx["module"]), ctx["module"])
                elif k == "trait" and e < z and t[e] == "{":
                    walk(e + 1, end, fq, {"trait": name, "module": ctx["module"], "names": ctx["names"]})
                elif k == "mod" and e < z and t[e] == "{":
                    walk(e + 1, end, fq, {})
                elif k == "enum" and e < z and t[e] == "{":
                    variants(e, end, fq, vis, set(re.findall(r"[<,]\s*(?:const\s+)?(\w+)", f.text[offset(j) : offset(e)])))
                elif k in ("struct", "union") and e < z and t[e] == "{":
                    for m in re.finditer(r"(?m)(pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*([^,\n}]+)", f.text[offset(e) + 1 : offset(end)]):
                        f.put("symbol", name=m.group(2), fqdn=f"{fq}::{m.group(2)}", kind="value", language_kind="field", module=fq, visibility="public" if m.group(1) else "private", target=m.group(3).strip(), start_line=f.line(offset(e) + 1 + m.start(2)), end_line=f.line(offset(e) + 1 + m.end()))
                i, pub, attrs = end + 1, False, []
                continue
            if k == "impl":
                e = i + 1
                while e < z and t[e] != "{":
                    e += 1
                end = close.get(e, e)
                head = re.sub(r"^impl\s*(?:<(?:[^<>]|<[^<>]*>)*>)?\s*", "", f.text[offset(i) : offset(e)].split(" where ")[0]).strip()
                of, _, ty = head.partition(" for ")
                if not ty:
                    of, ty = "", head
                name = nominal_head(ty)
                if of:
                    f.put("edge", fqdn=f"{owner}::{name}" if owner else name, kind="IMPLEMENTS", target=nominal_head(of.lstrip("!")), start_line=f.line(offset(i)))
                walk(e + 1, end, f"{owner}::{name}" if owner else name, {"impl": name, "of": nominal_head(of) if of else None, "module": ctx["module"], "names": ctx["names"]})
                i, pub, attrs = end + 1, False, []
                continue
            if k == "use":
                leaves: list[tuple[list[str], str | None]] = []
                _use_tree(t, w, i + 1, [], leaves)
                for path, alias in leaves:
                    tag = "wildcard" if path[-1] == "*" else "re-export" if pub else f"alias:{alias}" if alias else None
                    f.put("edge", fqdn=owner or f.module, kind="IMPORTS", target=_absolute([x for x in path if x != "*"], ctx["module"]), attribute=tag, start_line=f.line(offset(i)))
                    if pub and path[-1] != "*":
                        f.put("symbol", name=alias or path[-1], fqdn=f"{owner}::{alias or path[-1]}", kind="type", language_kind="re_export", module=owner, visibility="public", start_line=f.line(offset(i)), end_line=f.line(offset(i)))
                while i < z and t[i] != ";":
                    i = close.get(i, i) + 1 if t[i] == "{" else i + 1
                pub, attrs = False, []
            elif k == "extern" and i + 2 < z and t[i + 1] == "STR" and t[i + 2] == "{":
                end = close.get(i + 2, z)
                for j in range(i + 3, end):
                    if t[j] == "fn" and j + 1 < end:
                        f.put("ffi", fqdn=f"{owner}::{_name(w[j + 1])}", kind="import", target=_name(w[j + 1]), attribute=w[i + 1].strip('"').lower() or "c")
                i = end
            elif k in ("{", "(", "["):
                i = close.get(i, i)
            i += 1
            if k in (";", "}"):
                pub, attrs = False, []

    walk(0, n, f.module, {})


def _re_export(f: _File, t: list[str], w: list[str], o: list[int], close: dict[int, int], i: int) -> int:
    """IMPORTS edges of an ``export ... from``; the index behind it, or 0 if the export at ``i`` is none."""
    n = len(t)
    j = i + 2 if i + 2 < n and t[i + 1] == "type" and t[i + 2] in ("*", "{") else i + 1
    if j >= n or t[j] not in ("*", "{"):
        return 0
    names: list[str] = []
    tag, e = "re-export", close.get(j, j) + 1
    if t[j] == "*":
        tag, e = ("re-export,namespace", j + 3) if j + 1 < n and t[j + 1] == "as" else ("re-export,wildcard", j + 1)
    if e + 1 >= n or t[e] != "from" or t[e + 1] != "STR":
        return 0

    def shown(x: int) -> str:
        m = re.match(r"'([^'\n]*)'|\"([^\"\n]*)\"", f.text[o[x] :])
        return (m.group(1) or m.group(2) or "") if m else _name(w[x])

    x = j + 1
    while t[j] == "{" and x < e - 1:
        if t[x] == "type" and t[x + 1] not in (",", "}", "as"):
            x += 1
        names.append(shown(x))
        while x < e - 1 and t[x] != ",":
            x += 1
        x += 1
    module = resolve_module(shown(e + 1), f.path)
    for nm in names or [None]:
        f.put("edge", fqdn=f.module, kind="IMPORTS", target=f"{module}::{nm}" if nm else module, attribute=tag, start_line=f.line(o[i]))
    return e + 2


def _elements(f: _File, t: list[str], w: list[str], o: list[int], close: dict[int, int], spans: list[tuple[int, int, str]]) -> None:
    """REFERENCES of JSX: components, and the names read in attributes and between tags. ``spans``: who owns which tokens."""
    if "JSXB" not in t:
        return
    n = len(t)
    owner = [f.module] * n
    for a, z, fq in spans:  # outer ones come first
        owner[a : z + 1] = [fq] * (min(z + 1, n) - a)
    params: dict[int, int] = {}
    for x, z in close.items():
        if t[x] == "(" and z + 1 < n and t[z + 1] == "=>":
            params[x] = z
    #: Open elements and braces: [kind, end of the last piece, behind the opening tag?] and [tag, index of the closing brace].
    stack: list[list] = []
    bound = 0

    def gap(at: int) -> None:
        el = stack[-1]
        el[2] = el[2] or ">" in re.sub(r"\"[^\"]*\"|'[^']*'", "", f.text[el[1] : at])

    def put(i: int, name: str, tag: str) -> None:
        f.put("edge", fqdn=owner[i], kind="REFERENCES", target=name, attribute=tag, start_line=f.line(o[i]))

    i = 0
    while i < n:
        k = t[i]
        inside = bool(stack) and stack[-1][0] == "element"
        if i in params:
            bound = max(bound, params[i])
        if k == "JSXB":
            if inside:
                gap(o[i])
            m = re.match(r"<\s*([\w$.:-]*)", f.text[o[i] :])
            if m and re.fullmatch(r"[A-Z][\w$-]*", m.group(1)):
                put(i, m.group(1), "template-component-ref")
            stack.append(["element", o[i] + m.end() if m else o[i] + 1, False])
        elif k == "JSXE" and inside:
            stack.pop()
            if stack and stack[-1][0] == "element":
                stack[-1][1] = f.text.find(">", o[i]) + 1
        elif k == "{" and inside:
            gap(o[i])
            spread = not stack[-1][2] or i + 1 < n and t[i + 1] == "..."
            stack.append(["template-bind" if spread else "template-interpolation", close.get(i, n)])
        elif stack and not inside:
            if i >= stack[-1][1]:
                stack.pop()
                if stack and stack[-1][0] == "element":
                    stack[-1][1] = o[i] + 1
            elif k == "IDENT" and t[i - 1] not in (".", "?.", "as", "satisfies", "const", "let", "var", "function", "class", ":" if i < bound else "") and t[i + 1] != "=>" and not (t[i + 1] == ":" and t[i - 1] in ("{", ",")) and not (i < bound and t[i - 1] in ("(", ",", "{", "[", "...")) and _name(w[i]) not in JS_GLOBALS:
                put(i, _name(w[i]), stack[-1][0])
        i += 1


def script(f: _File, base: int = 0) -> None:
    ending = f.path.rsplit(".", 1)[-1]
    t, w, o, close = _words(f, lex_script(f.text, ending in ("tsx", "jsx", "js")))
    n = len(t)

    def offset(i: int) -> int:
        return o[i] if i < n else len(f.text)

    i, exported, depth_end = 0, False, []
    owners: list[tuple[int, str]] = []
    spans: list[tuple[int, int, str]] = []
    bound: dict[str, str] = {}

    def members(a: int, z: int, fq: str, kind: str) -> None:
        """Members between the braces of an interface or enum."""
        x, fresh = a + 1, True
        while x < z:
            if fresh and t[x] not in (",", ";", "}", "[") and re.match(r"[A-Za-z_$]", w[x]) and (kind == "enum" or t[x] != "readonly"):
                nxt = t[x + 1]
                if kind == "enum" and nxt in (",", "=", "}") or kind == "interface" and (nxt in ("?", ":", "(", "<")):
                    method = kind == "interface" and t[x + 2 if nxt == "?" and x + 2 < z else x + 1] in ("(", "<")
                    f.put("symbol", name=_name(w[x]), fqdn=f"{fq}::{_name(w[x])}", kind="callable" if method else "value", language_kind="enum_member" if kind == "enum" else "method" if method else "property", module=fq, visibility="public", start_line=f.line(offset(x)), end_line=f.line(offset(x)))
                fresh = False
            was = x
            x = close.get(x, x) + 1
            if x < z:
                fresh = fresh or t[x - 1] in (",", ";") or kind == "interface" and t[x] not in ("|", "&", "?", ":", ".", "[", "=>", "extends") and f.line(offset(x)) > f.line(offset(x - 1)) and t[x - 1] not in ("|", "&", ":", "=>", "<", ",")
                if t[was] in (",", ";"):
                    fresh = True

    def owner() -> str:
        while owners and owners[-1][0] < i:
            owners.pop()
        return owners[-1][1] if owners else f.module

    while i < n:
        k = t[i]
        own = owner()
        in_class = bool(owners) and owners[-1][1] != f.module
        if k == "import":
            j = i
            while j < n and t[j] not in ("STR", ";"):
                j += 1
            if j < n and t[j] == "STR":
                spec = f.text[offset(j) : offset(j + 1) if j + 1 < n else len(f.text)].strip().rstrip(";").strip().strip("'\"")
                names = [_name(w[x]) for x in range(i + 1, j) if t[x] == "IDENT" and not (x > 0 and t[x - 1] == "as")]
                bound |= {_name(w[x]): f"{resolve_module(spec, f.path)}::{_name(w[x - 2] if t[x - 1] == 'as' and t[x - 2] == 'IDENT' else w[x])}" for x in range(i + 1, j) if t[x] == "IDENT" and t[x + 1] != "as"}
                for nm in names or [None]:
                    f.put("edge", fqdn=f.module, kind="IMPORTS", target=f"{resolve_module(spec, f.path)}{'::' + nm if nm else ''}", start_line=f.line(offset(i)))
            i = j + 1
            exported = False
            continue
        if k == "export":
            j = _re_export(f, t, w, o, close, i)
            if j:
                i, exported = j, False
                continue
            exported = True
            i += 1
            continue
        vis = "public" if exported or in_class else "private"
        if k in ("class", "interface", "enum") and i + 1 < n and t[i + 1] not in ("{", "("):
            name = _name(w[i + 1])
            e = i + 2
            while e < n and t[e] != "{":
                e += 1
            end = close.get(e, e)
            fq = f.symbol(name, "type", k, own, offset(i), offset(end) + 1, visibility=vis)
            head = f.text[offset(i) : offset(e)]
            for word, kind in (("extends", "EXTENDS"), ("implements", "IMPLEMENTS")):
                m = re.search(rf"\b{word}\s+([^{{]+?)(?=\bimplements\b|$)", head)
                for b in re.split(r",(?![^<]*>)", m.group(1)) if m else ():
                    f.put("edge", fqdn=fq, kind=kind, target=nominal_head(b), start_line=f.line(offset(i)))
            if k in ("interface", "enum"):
                members(e, end, fq, k)
            if k == "class":
                owners.append((end, fq))
                i, exported = e + 1, False
                continue
            i, exported = end + 1, False
            continue
        if k == "type" and i + 2 < n and t[i + 1] == "IDENT" and t[i + 2] in ("=", "<"):
            e = i
            while e < n and t[e] != ";" and not (e > i + 3 and f.line(offset(e)) > f.line(offset(e - 1)) and t[e] not in ("|", "&")):
                e = close.get(e, e) + 1
            f.symbol(_name(w[i + 1]), "type", "type_alias", own, offset(i), offset(e), visibility=vis)
            i, exported = e, False
            continue
        name = e = None
        lk = "function"
        if k == "function" and i + 1 < n and (t[i + 1] == "IDENT" or t[i + 1] == "*"):
            j = i + 2 if t[i + 1] == "*" else i + 1
            name, p = _name(w[j]), j + 1
        elif in_class and (k == "IDENT" or k == "PRIVATE" or k in ("get", "set", "constructor")) and i + 1 < n and t[i + 1] in ("(", "<"):
            name, p, lk = _name(w[i]), i + 1, "constructor" if w[i].startswith("constructor") else "method"
        if name is not None:
            while p < n and t[p] != "(":
                p += 1
            e = close.get(p, p) + 1
            while e < n and t[e] not in ("{", ";"):
                e += 1
            if e < n and t[e] == "{":
                end = close.get(e, e)
                fq = f.symbol(name, "callable", lk, own, offset(i), offset(end) + 1, visibility=vis, receiver_type=own.rsplit("::", 1)[-1] if in_class else None, entry_point="binary_main" if name == "main" and own.count("::") <= 1 and not in_class else None)
                for ty in re.findall(r":\s*([A-Z]\w*)", f.text[offset(p) : offset(e)]):
                    f.put("edge", fqdn=fq, kind="USES_TYPE", target=ty, attribute="type-annotation", start_line=f.line(offset(i)))
                types = {"this": own.rsplit("::", 1)[-1]} if in_class else {}
                types |= dict(re.findall(r"(?:const|let|var)\s+(\w+)\s*=\s*new\s+(\w+)", f.text[offset(e) : offset(end)]))
                _calls(f, t, w, o, close, e, end, fq, types, bound)
                spans.append((e, end, fq))
                i, exported = end + 1, False
                continue
        if in_class and k in ("IDENT", "PRIVATE") and i + 1 < n and (t[i + 1] in (":", "=", ";", "!") or t[i + 1] == "?" and i + 2 < n and t[i + 2] == ":"):
            e = i
            while e < owners[-1][0] and t[e] != ";" and not (e > i and f.line(offset(e)) > f.line(offset(e - 1)) and t[e] not in (".", "?", ":", "+", "&&", "||", "|", "&", ")", "]", "}")):
                e = close.get(e, e) + 1
            fq = f.symbol(_name(w[i]), "value", "property", own, offset(i), offset(e), visibility="private" if k == "PRIVATE" or i and t[i - 1] in ("private", "protected") else "public", receiver_type=own.rsplit("::", 1)[-1])
            _calls(f, t, w, o, close, i + 1, min(e, n), fq, {"this": own.rsplit("::", 1)[-1]}, bound)
            i, exported = max(e, i + 1), False
            continue
        if k in ("const", "let", "var") and not in_class and i + 1 < n and t[i + 1] == "IDENT":
            e = i
            while e < n and t[e] != ";" and not (e > i + 2 and f.line(offset(e)) > f.line(offset(e - 1)) and t[e] not in (".", "?", ":", "+", "&&", "||", ")", "]", "}")):
                e = close.get(e, e) + 1
            fn = re.match(r"(?:const|let|var)\s+\w+\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", f.text[offset(i) : offset(e)])
            fq = f.symbol(_name(w[i + 1]), "callable" if fn else "value", "function" if fn else "const" if k == "const" else "var", own, offset(i), offset(e), visibility=vis)
            _calls(f, t, w, o, close, i + 2, min(e, n), fq if fn else f.module, {}, bound)
            if fn:
                spans.append((i + 2, min(e, n) - 1, fq))
            i, exported = e, False
            continue
        if k == ";" or k == "}":
            exported = False
        i += 1
    _elements(f, t, w, o, close, spans)


def resolve_module(spec: str, path: str) -> str:
    """Module of an import specifier: relative ones against the importing file's folder, packages as they are."""
    if not spec.startswith("."):
        return spec
    parts = path.replace("\\", "/").rsplit("/", 1)[0].split("/") if "/" in path else []
    for x in spec.split("/"):
        if x == "..":
            parts = parts[:-1]
        elif x != ".":
            parts = [*parts, x]
    p = "/".join(parts)
    p = p.rsplit("src/", 1)[-1]
    return re.sub(r"\.\w+$", "", p).replace("/", "::")


def _lua_end(t: list[str], i: int) -> int:
    """Index of the ``end`` of the block at ``i``."""
    n = len(t)
    depth, loop = 0, False
    while i < n:
        if t[i] in ("function", "if", "repeat"):
            depth += 1
        elif t[i] in ("while", "for"):
            depth, loop = depth + 1, True
        elif t[i] == "do":
            depth, loop = depth + (not loop), False
        elif t[i] in ("end", "until"):
            depth -= 1
            if depth <= 0:
                return i
        i += 1
    return n - 1


def lua(f: _File) -> None:
    t, w, o, close = _words(f, lex_lua(f.text))
    n = len(t)

    def offset(i: int) -> int:
        return o[i] if i < n else len(f.text)

    i = 0
    while i < n:
        if t[i] == "function" and i + 1 < n and t[i + 1] == "IDENT":
            local = i > 0 and t[i - 1] == "local"
            j, parts = i + 1, [_name(w[i + 1])]
            while j + 2 < n and t[j + 1] in (".", ":"):
                parts.append(_name(w[j + 2]))
                j += 2
            end = _lua_end(t, i)
            owner = "::".join([f.module, *parts[:-1]]) if f.module else "::".join(parts[:-1])
            fq = f.symbol(parts[-1], "callable", "method" if t[j - 1] == ":" else "local_function" if local else "function", owner, offset(i - 1 if local else i), offset(end) + 3, visibility="private" if local else "public", receiver_type=parts[-2] if len(parts) > 1 else None)
            _calls(f, t, w, o, close, j + 2, end, fq, {"self": parts[-2]} if len(parts) > 1 else {})
            i = end + 1
            continue
        if t[i] == "local" and i + 1 < n and t[i + 1] == "IDENT":
            f.symbol(_name(w[i + 1]), "value", "local", f.module, offset(i), offset(i + 2), visibility="private")
        if t[i] == "IDENT" and _name(w[i]) == "require" and i + 2 < n and t[i + 1 if t[i + 1] == "STR" else i + 2] == "STR":
            j = i + 1 if t[i + 1] == "STR" else i + 2
            spec = f.text[offset(j) : offset(j + 1)].strip().rstrip(")").strip().strip("'\"")
            f.put("edge", fqdn=f.module, kind="IMPORTS", target=spec.replace(".", "::").replace("/", "::"), start_line=f.line(offset(i)))
        i += 1
    for m in re.finditer(r"ffi\.cdef\s*\[\[(.*?)\]\]", f.text, re.S):
        for g in re.finditer(r"(\w+)\s*\([^;{]*\)\s*;", m.group(1)):
            f.put("ffi", fqdn=f"{f.module}::{g.group(1)}", kind="import", target=g.group(1), attribute="c")


def c(f: _File) -> None:
    for m in re.finditer(r"(?m)^\s*#\s*(include|define)\s+([<\"]?)([\w./-]+)(\(?)", f.text):
        if m.group(1) == "include":
            f.put("edge", fqdn=f.module, kind="IMPORTS", target=f"<builtin>::c::{m.group(3)}" if m.group(2) == "<" else m.group(3), start_line=f.line(m.start()))
        else:
            f.put("symbol", name=m.group(3), fqdn=f"{f.module}::{m.group(3)}", kind="macro", language_kind="macro_fn" if m.group(4) else "macro_object", module=f.module, visibility="public", start_line=f.line(m.start()), end_line=f.line(m.start()))
    t, w, o, close = _words(f, lex_c(f.text))
    n = len(t)

    def offset(i: int) -> int:
        return o[i] if i < n else len(f.text)

    i = start = 0
    while i < n:
        if t[i] in ("struct", "union", "enum") and i + 1 < n:
            j = i + 1 if t[i + 1] == "{" else i + 2
            if j < n and t[j] == "{":
                end = close.get(j, j)
                tail = _name(w[end + 1]) if end + 1 < n and t[end + 1] == "IDENT" else None
                name = _name(w[i + 1]) if t[i + 1] == "IDENT" else tail
                if name:
                    f.symbol(name, "type", t[i], f.module, offset(start), offset(end) + 1, visibility="public")
                if t[i] == "enum":
                    for m in re.finditer(r"(\w+)\s*(?:=[^,}]*)?(?:,|$)", f.text[offset(j) + 1 : offset(end)]):
                        f.put("symbol", name=m.group(1), fqdn=f"{f.module}::{m.group(1)}", kind="value", language_kind="enum_variant", module=f.module, visibility="public", start_line=f.line(offset(j) + 1 + m.start()), end_line=f.line(offset(j) + 1 + m.start()))
                i = end + 1
                continue
        if t[i] == "(" and i > start and t[i - 1] == "IDENT" and i - 1 > start:
            e = close.get(i, i)
            name = _name(w[i - 1])
            if e + 1 < n and t[e + 1] in ("{", ";"):
                static = "static" in t[start:i]
                end = close.get(e + 1, e + 1) if t[e + 1] == "{" else e + 1
                fq = f.symbol(name, "callable", "fn" if t[e + 1] == "{" else "fn_decl", f.module, offset(start), offset(end) + 1, visibility="private" if static else "public", entry_point="ffi_export" if name == "main" or name.startswith("luaopen_") else None)
                if t[e + 1] == "{":
                    if not static:
                        f.put("ffi", fqdn=fq, kind="export", target=name, attribute="c")
                    _calls(f, t, w, o, close, e + 1, end, fq, {})
                i = start = end + 1
                continue
            i = e
        elif t[i] == "{":
            i = close.get(i, i)
        if i < n and t[i] in (";", "}"):
            start = i + 1
        i += 1
    for m in re.finditer(r"lua_register\s*\(\s*\w+\s*,\s*\"(\w+)\"", f.text):
        f.put("ffi", fqdn=f"{f.module}::{m.group(1)}", kind="export", target=m.group(1), attribute="lua")


def component(f: _File) -> None:
    """Scripts of a component in place (all else blanked, so lines stay), then what its markup refers to."""
    markup = list(f.text)
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script\s*>", f.text, re.S | re.I):
        blank = re.sub(r"[^\n]", " ", f.text[: m.start(1)]) + m.group(1)
        part = _File(f.path, blank, f.language, f.module, f.returns)
        script(part)
        f.rows += part.rows
        markup[m.start() : m.end()] = re.sub(r"[^\n]", " ", m.group(0))
    text = re.sub(r"<style\b.*?</style\s*>", lambda m: re.sub(r"[^\n]", " ", m.group(0)), "".join(markup), flags=re.S | re.I)
    for rx, tag in ((r"<([A-Z]\w*)", "template-component-ref"), (r"(?:@|v-on:|on:)[\w.:-]+=[\"{]\s*(?:\(\)\s*=>\s*)?([A-Za-z_]\w*)", "template-event"), (r"(?::|v-bind:|bind:)[\w.-]+=[\"{]\s*([A-Za-z_]\w*)", "template-bind"), (r"v-[\w-]+=\"\s*([A-Za-z_]\w*)", "template-directive"), (r"\{\{?\s*([A-Za-z_]\w*)", "template-interpolation"), (r"\{#\w+\s+([A-Za-z_]\w*)", "template-directive")):
        for m in re.finditer(rx, text):
            f.put("edge", fqdn=f.module, kind="REFERENCES", target=m.group(1), attribute=tag, start_line=f.line(m.start(1)))


WALKERS = {"rust": rust, "typescript": script, "javascript": script, "lua": lua, "c": c, "vue": component, "svelte": component}
_PAIRS = [x for k, v in expr.EXTENSIONS.items() for x in (k, v)]


def extract_text(path: str, text: str, module: str, returns: dict[str, str] | None = None) -> list[dict]:
    """All rows of one file; its module symbol first."""
    import hashlib

    language = expr.EXTENSIONS.get(path.rsplit(".", 1)[-1])
    if language is None:
        return []
    f = _File(path, text, language, module, returns or {})
    f.put("symbol", name=module.rsplit("::", 1)[-1] or path, fqdn=module or path, kind="module", language_kind="module", visibility="public", start_line=1, end_line=text.count("\n") + 1, body_hash=hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
    WALKERS[language](f)
    return f.rows


def extract(files: DataFrame, returns: DataFrame | None = None) -> DataFrame:
    """Rows of SCHEMA for files (path, content, project): ``project`` heads the module path; null contents yield nothing.

    ``returns`` are the rows of :func:`return_types`. Each file gets those of the names it may call, by a join on the name.
    """
    spark = ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        args = pa.list_(pa.struct([("value", pa.string()), ("is_string_literal", pa.bool_())]))
        schema = pa.schema([(x, args if x == "args" else pa.int32() if x.endswith("_line") else pa.string()) for x in _COLS])
        for b in batches:
            rows = [r for p, m, text, known in zip(*(b.column(i).to_pylist() for i in range(4))) for r in extract_text(p, text, m, dict(known or ()))]
            yield pa.RecordBatch.from_pydict({x: [r.get(x) for r in rows] for x in _COLS}, schema=schema)

    head = F.coalesce(F.regexp_replace("project", "-", "_"), F.lit(""))
    mod = expr.module_path(F.regexp_replace("path", "^ws:[^:]*:", ""))
    # Never null, also for the planner: else the join filters one of its two branches, and the exchange isn't shared.
    module = F.coalesce(F.when(mod == "", head).when(head == "", mod).otherwise(F.concat_ws("::", head, mod)), head)
    d = files.where("path is not null and content is not null").select("path", module.alias("module"), "content")
    if returns is None:
        return d.withColumn("known", F.lit(None).cast("map<string,string>")).mapInArrow(run, SCHEMA)
    # The names a file may ask for leave it as a narrow projection; what is known of them comes back by path.
    names = F.array_distinct(F.when(F.endswith("path", F.lit(".rs")), F.regexp_extract_all("content", F.lit(_ASSIGNED), 1)))
    called = d.select("path", F.explode(names).alias("name")).join(returns, "name")
    known = called.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("name", "return_type"))).alias("known"))
    return d.join(known, "path", "left").select("path", "module", "content", "known").mapInArrow(run, SCHEMA)


#: Names that may be called in a ``let`` (a superset of what :func:`rust` asks for), with Python's classes.
_ASSIGNED = r"(?U)=[\s\x1c-\x1f]*(\w+)[\s\x1c-\x1f]*\("


def return_types(files: DataFrame) -> DataFrame:
    """name, return_type: the nominal return type of Rust functions whose name has one return type in all files."""
    sig = files.where("path like '%.rs' and content is not null").select(F.explode(F.regexp_extract_all("content", F.lit(r"(fn\s+\w+\s*(?:<[^>{}]*>)?\s*\([^{};]*\)\s*->\s*[^{;]+)"), 1)).alias("s"))
    one = sig.select(F.regexp_extract("s", r"fn\s+(\w+)", 1).alias("name"), F.regexp_extract("s", r"->\s*&?(?:'\w+\s+)?(?:mut\s+)?([A-Za-z_][\w:]*)", 1).alias("ty")).where("ty <> ''")
    single = one.groupBy("name").agg(F.min("ty").alias("ty"), F.max("ty").alias("t2")).where("ty = t2")
    return single.select("name", F.substring_index("ty", "::", -1).alias("return_type"))


def module_lookups(rows: DataFrame) -> DataFrame:
    """module, side, name, origin_module, origin_symbol, resolved_fqdn, re_export of each module, from rows of :func:`extract`.

    ``export`` rows are the public names of a module's root scope, re-exports among them with where they come from; ``import``
    rows its local names. A wildcard has the symbol ``*``. A name that is bound twice keeps its first binding by line.
    """
    last, head = expr.last_segment(F.col("target")), expr.parent(F.col("target"))
    wild = F.contains(F.coalesce("attribute", F.lit("")), F.lit("wildcard"))
    again = F.contains(F.coalesce("attribute", F.lit("")), F.lit("re-export"))
    alias = F.regexp_extract(F.coalesce("attribute", F.lit("")), "alias:(\\w+)", 1)
    i = rows.where("what = 'edge' and kind = 'IMPORTS' and target <> ''").select(
        F.col("fqdn").alias("module"), F.lit("import").alias("side"), F.when(wild, "*").when(alias != "", alias).otherwise(last).alias("name"),
        F.when(wild, F.col("target")).otherwise(F.coalesce(head, F.lit(""))).alias("origin_module"), F.when(wild, "*").otherwise(last).alias("origin_symbol"), F.lit(None).cast("string").alias("resolved_fqdn"), (again | wild).alias("re_export"), "start_line")
    e = rows.where("what = 'symbol' and visibility = 'public' and module is not null and kind <> 'module'").select(
        "module", F.lit("export").alias("side"), "name", F.lit(None).cast("string").alias("origin_module"), F.lit(None).cast("string").alias("origin_symbol"), F.col("fqdn").alias("resolved_fqdn"), (F.col("language_kind") == "re_export").alias("re_export"), "start_line")
    rest = ["origin_module", "origin_symbol", "resolved_fqdn", "re_export"]
    one = i.unionByName(e).groupBy("module", "side", "name").agg(F.min_by(F.struct(*rest), F.struct("start_line", *rest)).alias("r"))
    return one.select("module", "side", "name", "r.*")


def with_builtins(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of :func:`extract` after the tiers of built-in names (language, name, tier, synthetic_fqdn): edges to ``drop`` names
    go, ``attribute`` names become a flag in ``attribute``, ``edge`` names lead to their synthetic symbol. All else stays.

    Type uses, traits and macros are looked up by their last segment, calls of Rust only where it begins with a capital (a
    variant or tuple type); calls of the other languages by what they begin with.
    """
    language = F.create_map(*[F.lit(x) for x in _PAIRS])[F.regexp_extract("path", r"\.([^.]+)$", 1)]
    last = expr.last_segment(F.col("target"))
    called = (F.col("kind") == "CALLS") & ~(F.coalesce("attribute", F.lit("")) == "macro")
    name = F.when(F.col("what") != "edge", None).when(F.col("kind").isin("IMPORTS", "REFERENCES"), None).when(~called, last).when(language == "rust", F.when(last.rlike("^[A-Z]"), last)).otherwise(F.regexp_extract("target", r"^([^.:]+)", 1))
    known = F.when(language.isin("vue", "svelte"), "typescript").otherwise(language)
    j = rows.withColumn("__l", known).withColumn("__n", name).join(registry.select(F.col("language").alias("__l"), F.col("name").alias("__n"), "tier", "synthetic_fqdn"), ["__l", "__n"], "left")
    kept = j.where("tier is null or tier <> 'drop'")
    flag = F.concat_ws(",", "attribute", F.concat(F.lit("builtin-"), F.lower("__n")))
    return kept.withColumn("attribute", F.when(F.col("tier") == "attribute", flag).otherwise(F.col("attribute"))).withColumn("target", F.when((F.col("tier") == "edge") & ~F.startswith("target", F.lit("<builtin>")), F.col("synthetic_fqdn")).otherwise(F.col("target"))).select(*rows.columns)
