"""Recognisers from grammar texts: prediction tables over token types, with a chart for what is tried twice.

A grammar is a list of rules ``name = alternatives``; ``/`` separates ordered alternatives, ``? * +`` repeat, ``& !`` look
ahead, ``'x'`` is a token of that type, a name in capitals a token class or set, ``~`` asks for no line break before the next
token, ``ASI`` for an end of statement that may be left out. A line ``%set NAME = A 'b' ...`` names a set of token types, and
``@name = ...`` keeps the rule's results per position (the chart), so that backtracking stays linear in them. Grammars may
extend one another: a later text overrides rules of the same name.

Each alternative's possible first tokens are worked out once; at run time a choice is one table lookup, and only
alternatives that can begin with the token at hand are tried.
"""

from __future__ import annotations

import re
import sys
from functools import cached_property

_PIECE = re.compile(r"\s*(?:(#[^\n]*)|'((?:[^'\\]|\\.)+)'|([A-Za-z_][A-Za-z0-9_]*)|([()/?*+&!~]))")
EOF, ERR = "EOF", "ERR"


def _read(texts: list[str]) -> tuple[dict[str, tuple], dict[str, frozenset[str]], set[str]]:
    rules: dict[str, tuple] = {}
    sets: dict[str, frozenset[str]] = {}
    memo: set[str] = set()
    for text in texts:
        entries: list[str] = []
        for line in text.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if line[0].isspace():
                entries[-1] += " " + line.strip()
            else:
                entries.append(line)
        for e in entries:
            head, _, body = e.partition("=")
            head = head.strip()
            if head.startswith("%set"):
                name = head.split()[1]
                out: set[str] = set()
                for m in _PIECE.finditer(body):
                    if m.group(2):
                        out.add(m.group(2))
                    elif m.group(3):
                        out |= sets.get(m.group(3), {m.group(3)})
                sets[name] = frozenset(out)
                continue
            if head.startswith("@"):
                head = head[1:]
                memo.add(head)
            toks = [(2, m.group(2)) if m.group(2) else (3, m.group(3)) if m.group(3) else (4, m.group(4)) for m in _PIECE.finditer(body) if not m.group(1)]
            node, i = _alternatives(toks, 0)
            if i != len(toks):
                raise ValueError(f"rule {head}: {toks[i:]}")
            rules[head] = node
    return rules, sets, memo


def _alternatives(t: list, i: int) -> tuple[tuple, int]:
    alts = []
    while True:
        items = []
        while i < len(t) and t[i] not in ((4, "/"), (4, ")")):
            node, i = _item(t, i)
            items.append(node)
        alts.append(items[0] if len(items) == 1 else ("seq", items))
        if i < len(t) and t[i] == (4, "/"):
            i += 1
            continue
        return (alts[0] if len(alts) == 1 else ("alt", alts)), i


def _item(t: list, i: int) -> tuple[tuple, int]:
    kind, v = t[i]
    if kind == 4 and v in "&!":
        node, i = _item(t, i + 1)
        return (v, node), i
    if kind == 4 and v == "~":
        node: tuple = ("nonl",)
        i += 1
        return node, i
    if kind == 4 and v == "(":
        node, i = _alternatives(t, i + 1)
        i += 1
    elif kind == 2:
        node, i = ("tok", v), i + 1
    else:
        node, i = ("ref", v), i + 1
    while i < len(t) and t[i][0] == 4 and t[i][1] in "?*+":
        node = (t[i][1], node)
        i += 1
    return node, i


class Recogniser:
    """``check(types, breaks)`` gives -1 for a text of the language, else the index of the token no parse gets past."""

    def __init__(self, texts: list[str], start: str = "start"):
        self.rules, self.sets, self.memo_names = _read(texts)
        self.start = start
        self.first: dict[str, tuple[frozenset[str], bool]] = {k: (frozenset(), False) for k in self.rules}
        changed = True
        while changed:
            changed = False
            for k, node in self.rules.items():
                f = self._first(node)
                if f != self.first[k]:
                    self.first[k], changed = f, True
        self.types: list[str] = []
        self.breaks: list[bool] = []
        self.far = [0]
        self.charts: list[dict[int, int]] = []
        self.fast = self._compile(False)
        self.slow = self._compile(True)

    ANYTHING = frozenset(["\0any"])

    def _first(self, node: tuple) -> tuple[frozenset[str], bool]:
        """(types a match can begin with, may it be empty); the set with \\0any means any type."""
        kind = node[0]
        if kind == "tok":
            return frozenset([node[1]]), False
        if kind == "ref":
            n = node[1]
            if n in self.rules:
                return self.first[n]
            if n == "ASI":
                return frozenset([";"]), True
            if n == "ANY":
                return self.ANYTHING, False
            return self.sets.get(n, frozenset([n])), False
        if kind in "&!" or kind == "nonl":
            return frozenset(), True
        if kind in "?*":
            return self._first(node[1])[0], True
        if kind == "+":
            return self._first(node[1])
        if kind == "seq":
            out: frozenset[str] = frozenset()
            for x in node[1]:
                f, empty = self._first(x)
                out |= f
                if not empty:
                    return out, False
            return out, True
        fs = [self._first(x) for x in node[1]]
        return frozenset().union(*[f for f, _ in fs]), any(e for _, e in fs)

    def _compile(self, track: bool):
        T, B, far = self.types, self.breaks, self.far
        made: dict[str, list] = {k: [None] for k in self.rules}
        busy: set[str] = set()

        def tok(t: str):
            if track:
                def f(p: int) -> int:
                    if T[p] == t:
                        return p + 1
                    if p > far[0]:
                        far[0] = p
                    return -1
            else:
                def f(p: int) -> int:
                    return p + 1 if T[p] == t else -1
            return f

        def member(s: frozenset[str]):
            def f(p: int) -> int:
                if T[p] in s:
                    return p + 1
                if track and p > far[0]:
                    far[0] = p
                return -1
            return f

        def build(node: tuple):
            kind = node[0]
            if kind == "tok":
                return tok(node[1])
            if kind == "ref":
                n = node[1]
                if n in made:
                    cell = made[n]
                    if cell[0] is None and n not in busy:
                        rule(n)
                    # Only a rule that refers back to itself is reached through its cell.
                    return cell[0] or (lambda p: cell[0](p))
                if n == "ASI":
                    def asi(p: int) -> int:
                        t = T[p]
                        if t == ";":
                            return p + 1
                        if t == "}" or t == EOF or B[p]:
                            return p
                        if track and p > far[0]:
                            far[0] = p
                        return -1
                    return asi
                if n == "ANY":
                    closed = frozenset([EOF, ERR, "(", ")", "[", "]", "{", "}"])
                    return lambda p: -1 if T[p] in closed else p + 1
                return member(self.sets[n]) if n in self.sets else tok(n)
            if kind == "nonl":
                return lambda p: -1 if B[p] else p
            if kind == "&":
                g = build(node[1])
                return lambda p: p if g(p) >= 0 else -1
            if kind == "!":
                g = build(node[1])

                def neg(p: int) -> int:
                    kept = far[0]
                    r = g(p)
                    far[0] = kept
                    return p if r < 0 else -1
                return neg
            if kind == "?":
                g, (s, _) = build(node[1]), self._first(node[1])
                if "\0any" in s or self._first(node[1])[1]:
                    def opt_any(p: int) -> int:
                        r = g(p)
                        return r if r >= 0 else p
                    return opt_any

                def opt(p: int) -> int:
                    if T[p] in s:
                        r = g(p)
                        if r >= 0:
                            return r
                    return p
                return opt
            if kind in "*+":
                g, (s, empty) = build(node[1]), self._first(node[1])
                loose, least = "\0any" in s or empty, kind == "+"

                def many(p: int) -> int:
                    if least:
                        p = g(p)
                        if p < 0:
                            return -1
                    while loose or T[p] in s:
                        r = g(p)
                        if r <= p:
                            break
                        p = r
                    return p
                return many
            if kind == "seq":
                gs = tuple(build(x) for x in node[1])
                if len(gs) == 2:
                    a, b = gs

                    def two(p: int) -> int:
                        p = a(p)
                        return b(p) if p >= 0 else -1
                    return two

                def seq(p: int) -> int:
                    for g in gs:
                        p = g(p)
                        if p < 0:
                            return -1
                    return p
                return seq
            alts = [(build(x), *self._first(x)) for x in node[1]]
            every = tuple(g for g, s, e in alts if e or "\0any" in s)
            table: dict[str, tuple] = {}
            for t in frozenset().union(*[s for _, s, _ in alts]):
                table[t] = tuple(g for g, s, e in alts if e or t in s or "\0any" in s)
            get = table.get

            def choose(p: int) -> int:
                gs = get(T[p], every)
                for g in gs:
                    r = g(p)
                    if r >= 0:
                        return r
                if track and p > far[0]:
                    far[0] = p
                return -1
            return choose

        def rule(k: str) -> None:
            busy.add(k)
            f = build(self.rules[k])
            busy.discard(k)
            if k in self.memo_names:
                chart: dict[int, int] = {}
                self.charts.append(chart)

                def kept(p: int) -> int:
                    r = chart.get(p)
                    if r is None:
                        r = chart[p] = f(p)
                    return r
                made[k][0] = kept
            else:
                made[k][0] = f

        rule(self.start)
        return made[self.start]

    def check(self, types: list[str], breaks: list[bool]) -> int:
        self.types[:] = [*types, EOF]
        self.breaks[:] = [*breaks, True]
        if sys.getrecursionlimit() < DEPTH:
            sys.setrecursionlimit(DEPTH)
        for c in self.charts:
            c.clear()
        try:
            if self.fast[0](0) >= 0:
                return -1
            for c in self.charts:
                c.clear()
            self.far[0] = 0
            self.slow[0](0)
        except RecursionError:
            return self.machine.check(self.types, self.breaks)
        finally:
            for c in self.charts:
                c.clear()
        return min(self.far[0], len(types))

    @cached_property
    def machine(self) -> Machine:
        return Machine(self)


#: Nesting of calls up to which the compiled functions run; deeper texts go through :class:`Machine`, with the same result.
DEPTH = 150_000
#: Instructions: match a type, a set of types, anything but closing marks, an optional end of statement, no line break; call,
#: return; push a point to come back to, give it up; the ends of look-aheads and repetitions; fail; done.
_TOK, _SET, _ANY, _ASI, _NONL, _CALL, _RET, _CHOICE, _COMMIT, _BACK, _FAILTWICE, _LOOP, _FAIL, _END = range(14)


class Machine:
    """The same grammar run with a stack of its own, for texts nested deeper than Python's calls may be.

    Rules become instructions; the stack holds places to return to (two fields) and points to come back to after a failure
    (three fields). Rules with a chart look there first and note both success and failure.
    """

    def __init__(self, of: Recogniser):
        self.of = of
        self.code: list[tuple] = []
        self.entry: dict[str, int] = {}
        self.code += [(_CALL, of.start), (_END,)]
        for name, node in of.rules.items():
            self.entry[name] = len(self.code)
            self._emit(node)
            self.code.append((_RET,))
        self.code = [(_CALL, self.entry[c[1]], c[1] if c[1] in of.memo_names else None) if c[0] == _CALL else c for c in self.code]

    def _emit(self, node: tuple) -> None:
        code, of, kind = self.code, self.of, node[0]
        if kind == "tok":
            code.append((_TOK, node[1]))
        elif kind == "ref":
            n = node[1]
            code.append((_CALL, n) if n in of.rules else (_ASI,) if n == "ASI" else (_ANY,) if n == "ANY" else (_SET, of.sets[n]) if n in of.sets else (_TOK, n))
        elif kind == "nonl":
            code.append((_NONL,))
        elif kind == "seq":
            for x in node[1]:
                self._emit(x)
        elif kind == "alt":
            ends = []
            for x in node[1][:-1]:
                at = len(code)
                code.append(())
                self._emit(x)
                ends.append(len(code))
                code.append(())
                code[at] = (_CHOICE, len(code), self._starts(x))
            self._emit(node[1][-1])
            for e in ends:
                code[e] = (_COMMIT, len(code))
        elif kind == "?":
            at = len(code)
            code.append(())
            self._emit(node[1])
            code.append((_COMMIT, len(code) + 1))
            code[at] = (_CHOICE, len(code), self._starts(node[1]))
        elif kind in "*+":
            if kind == "+":
                self._emit(node[1])
            at = len(code)
            code.append(())
            self._emit(node[1])
            code.append((_LOOP, at))
            code[at] = (_CHOICE, len(code), self._starts(node[1]))
        else:
            at = len(code)
            code.append(())
            self._emit(node[1])
            code.append((_BACK, len(code) + 2) if kind == "&" else (_FAILTWICE,))
            if kind == "&":
                code.append((_FAIL,))
            code[at] = (_CHOICE, len(code) - (kind == "&"), None, kind == "!")

    def _starts(self, node: tuple) -> frozenset[str] | None:
        first, empty = self.of._first(node)
        return None if empty or "\0any" in first else first

    def check(self, types: list[str], breaks: list[bool]) -> int:
        """As :meth:`Recogniser.check`; ``types`` end with EOF."""
        code, closed = self.code, frozenset([EOF, ERR, "(", ")", "[", "]", "{", "}"])
        chart: dict[tuple[str, int], int] = {}
        stack: list[tuple] = []  # (return to, rule with chart or None, its start) or (go on at, position, farthest failure to restore or -1)
        pc = p = far = 0
        while True:
            ins = code[pc]
            op = ins[0]
            pc += 1
            ok = True
            if op == _TOK:
                ok = types[p] == ins[1]
                p += ok
            elif op == _SET:
                ok = types[p] in ins[1]
                p += ok
            elif op == _CALL:
                known = chart.get((ins[2], p)) if ins[2] else None
                if known is None:
                    if ins[2]:
                        stack.append((-2, ins[2], p))  # a failure ends here: note it
                    stack.append((-1, pc, ins[2], p))
                    pc = ins[1]
                elif known < 0:
                    ok = False
                else:
                    p = known
            elif op == _RET:
                _, pc, rule, start = stack.pop()
                if rule:
                    stack.pop()
                    chart[rule, start] = p
            elif op == _CHOICE:
                if ins[2] is not None and types[p] not in ins[2]:
                    far = max(far, p)
                    pc = ins[1]
                else:
                    stack.append((ins[1], p, far if len(ins) > 3 and ins[3] else -1))
            elif op == _COMMIT:
                stack.pop()
                pc = ins[1]
            elif op == _LOOP:
                go, at, _ = stack.pop()
                pc = ins[1] if p > at else go
            elif op == _BACK:
                _, p, _ = stack.pop()
                pc = ins[1]
            elif op == _FAILTWICE:
                _, _, far = stack.pop()
                ok = False
            elif op == _ASI:
                if types[p] == ";":
                    p += 1
                else:
                    ok = types[p] in ("}", EOF) or breaks[p]
            elif op == _NONL:
                ok = not breaks[p]
            elif op == _ANY:
                ok = types[p] not in closed
                p += ok
            elif op == _FAIL:
                ok = False
            else:
                return -1
            if ok:
                continue
            if op in (_TOK, _SET, _ASI):
                far = max(far, p)
            while stack:
                top = stack.pop()
                if top[0] == -2:
                    chart[top[1], top[2]] = -1
                elif top[0] >= 0:
                    pc, p = top[0], top[1]
                    far = far if top[2] < 0 else top[2]  # what a look-ahead for absence saw doesn't count
                    break
            else:
                return min(far, len(types) - 1)
