"""Small valid and broken texts of every language."""

import pytest

from lodestone.llm import syntax
from lodestone.llm.syntax import judge

VALID = {
    "rust": [
        "", "// only\n", "/* a /* b */ c */", "#![allow(x)]\nuse a::{b, c::*, self as d};\nmod m;\npub(crate) mod n { pub use super::*; }",
        "pub struct A<'a, T: Clone + 'a, const N: usize = 3>(pub &'a [T; N], Vec<Vec<u8>>) where T: Fn(u8) -> u8;",
        "impl<T> Trait<T> for Foo<T> where for<'a> &'a T: Add<Output = T> { type X = T; const C: u8 = b'x'; fn f(&mut self, x: impl Fn() -> T) -> Option<Box<dyn Fn(&str) + Send>> { None } }",
        "fn f() -> u8 { let x = if a < b { 1 } else { 2 }; match x { 0 | 1 => {} 2..=5 if x > 3 => return 4, Foo::Bar { a, ref b, .. } => x as u8, _ => unreachable!(\"{}\", x), } x << 2 >> 1 }",
        "fn g() { for (i, x) in v.iter().enumerate() { if let Some(y) = x && y > 3 { continue 'a; } } 'a: loop { break 'a; } let c = |a: u8, &b| -> u8 { a + b }; let r = r#\"<<<<<<< \" }\"#; let q = 'a'; }",
        "async fn h() -> Result<(), E> { x.await?; let Some(z) = w else { return Err(e); }; unsafe { *p = 1; } Foo { a: 1, ..Default::default() }.run::<Vec<u8>>(); a[0..3].len(); Ok(()) }",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nenum E { A = 1, B(u8), C { x: i32 } }\ntrait T: Sized { fn a(); fn b(&self) { } }\nstatic X: &str = \"a\\\"b\";\nextern \"C\" { fn puts(s: *const u8) -> i32; }",
    ],
    "typescript": [
        "import type { A } from './a'; import B, * as C from \"b\"; export * from 'c'; export default class X<T = any> extends Y<T> implements Z { private readonly x?: number = 1; static #p = 2; constructor(public a: string, b?: T) { super(); } get v(): number { return this.x!; } async *gen(): AsyncGenerator<number> { yield 1 } [key: string]: any }",
        "interface A<T> extends B { a: string; b?(x: number): void; readonly [k: string]: T; new (x: T): A<T>; (y: T): void }\ntype U = | 'a' | `b${string}` | { [K in keyof T]?: T[K] } | ((x: number, ...r: string[]) => asserts x is number) | typeof import('x') | [a: string, b?: number];",
        "enum E { A = 1, B = 'x' } declare module 'm' { export const x: number; } namespace N.M { let y = <any>z; } declare global { interface W {} } abstract class Q { abstract f(): void; }",
        "const f = async <T extends object>(x: T, { a, b = 2 }: P = {}): Promise<T[]> => { for await (const y of x as any) { y?.z?.[0]?.(); } return x satisfies T; };\nlet v = a < b && c > d; const g = h<string>(1); let n = x! + y as const;",
        "function over(a: string): void\nfunction over(a: number): void\nfunction over(a: any) { if (/[/}]\\/x/g.test(a)) return `t ${`n ${a}`} e`; label: for (;;) break label }",
    ],
    "javascript": [
        "var a = 1, {b, c: [d = 2, ...e]} = f\nlet g = (x) => ({ x, get y() { return 1 }, async *z() {}, ['k']: 1 })\nif (a) b(); else { c() }\nx = a / b / c; y = a ? b : c ? d : e\nexport { a as default, b }; import('x').then(y => y)",
        "class A { static { x() } static async *m() {} 'q' = 1; #r; get() {} set(v) {} }\nfor (const x of y) ; for (var i in o) ; for (let i = 0, n = 3; i < n; i++) { }\ntry { } catch { } finally { }\nswitch (x) { case 1: case 2: y(); break; default: }",
        "const j = <div a=\"1\" b={x} {...p}>text {y ? <b/> : null} <></></div>;\nnew Foo; new a.b.C(1).d; a ??= b; a ||= /x/; async function q() { await r }\n`a${b}c`; do x++; while (y) z()",
        "!function(){var a=1;return a}();var b=function(c){for(var d=0;d<c.length;d++)c[d]|=126;return c};",
    ],
    "lua": [
        "#!/usr/bin/lua\nlocal a <const>, b = 1, 'x'\nfunction M.f.g:h(...) local t = { 1, x = 2, [3] = 4; f() } return ... end\nfor i = 1, 10, 2 do goto c ::c:: end\nfor k, v in pairs(t) do a.b[1]:c 'x' { } end\nrepeat until not #a == 0x1p4 // 2 ~ 3\nlocal s = [==[ ]] end ]==] --[[ x\n end ]] return",
        "if a then elseif b then else end; (f or g)(1).x = 2; a, b.c = b, a",
    ],
    "c": [
        "#include <a.h>\n#if 0\n garbage ' (\n#else\nint x;\n#endif\n#define M(a) do { \\\n  a; } while (0)\ntypedef struct s { int a : 3; union { float f; } u; } s_t, *s_p;\nstatic const char *names[] = { [A] = \"x\" \"y\", \"\\\"\" };\nint (*fp)(void *, size_t n), arr[3][4];",
        "static inline uint32_t f(const foo_t *restrict p, int n, ...)\n{\n  for (size_t i = 0; i < n; i++) { p->a[i] ^= (uint8_t)~x << 2; if (!p) goto out; else continue; }\n  switch (n) { case 1 ... 3: default: break; }\n  foo *q = &(foo){ .x = 1 }; do { n--; } while (n > 0);\nout:\n  return sizeof(int) * sizeof *p + (n ? 'a' : L'\\n') + 0x1fULL;\n}\nenum { A = 1, B, };",
    ],
    "vue": ["// note\n<template>\n <p v-if=\"a > b\" @click=\"x\">{{ a }}<br></p>\n</template>\n<script setup lang=\"ts\">\nconst a: number = 1\n</script>\n<style scoped>a { b: c }</style>\n"],
    "svelte": ["<script lang=\"ts\">\nlet a: string\n</script>\n<div class={x}>{#if a}<b on:click={() => { y() }}>{a}</b>{:else}z{/if}{#each q as r}{r}{/each}<input></div>\n"],
}
BROKEN = {
    "rust": ["fn f() {", "fn f() { let x = ; }", "fn f() { let a = 1 let b = 2; }", "<<<<<<< HEAD\nfn f() {}\n", "let s = \"abc", "local M = {}", "#include <a.h>\nint x;", "fn f(a: u8 b: u8) {}", "fn f() { a.push(1; }", "/* open", "fn f() { x(1)) }", "struct A { a: u8; b: u8 }", "# Notes\n\n- one\n"],
    "typescript": ["class A {", "const x = ;", "=======\nlet a", "let x: = 3", "foo(1, 2", "`abc ${x", "use std::io;\nfn main() {}", "if (a { b }", "function f( { }", "import { a from 'b'", "const s = 'abc\n'", "{\"a\": {\"b\": 1}}", "let a = 1 let b"],
    "javascript": ["function f(a: string) {}", "const x: number = 1", "interface A {}\nlet x = a as any", "var a = {b: 1", "x = (1 + ", "}", "let y = /abc", "<<<<<<< HEAD\na()\n=======\nb()\n>>>>>>> x", "{\"a\": 1}", "enum E { A }", "class A { private x = 1 }"],
    "lua": ["function f()", "local x = ", "if a then", "x = = 2", "a b", "end", "#include <a.h>\n#include \"b\"\nint x;", "local s = 'abc\n'", "f(1", "--[[ open", "x.y", "for i = 1 do end"],
    "c": ["int f() {", "int x = ;", "void f(void) { a(1; }", "#if A\nint x;\n", "char *s = \"abc\n", "use a::b;", "local M = {}", "int f(void) { return 1 }", "}", "/* open", "void f(void) { if (a { } }", "int a b c;;; struct {"],
    "vue": ["<template><p></template>", "<template><p></p>", "<script>\nlet a = \n</script>", "<script>\nlet a: number = 1\n</script>", "<template>\n<<<<<<< HEAD\n<p></p>\n=======\n>>>>>>> x\n</template>"],
    "svelte": ["<script>\nlet a", "<div>{#if a}</div>", "<div>{a</div>", "<p><b></p></b>", "<script lang=\"ts\">let a: = 1</script>"],
}


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(lang, text):
    assert judge(text, lang, "a." + {"javascript": "jsx"}.get(lang, "x"), "syntax error") == (False, None)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(lang, text):
    bad, line = judge(text, lang, "a.x", None)
    assert bad and 1 <= line <= text.count("\n") + 1


def test_spelling_null_and_deep():
    assert judge("fn f() {", " Rust ", None, None)[0] and judge("fn f() {", None, "a/b.rs", None)[0]
    assert judge("fn f() {", None, None, None) == (False, None)
    assert judge(None, "rust", "a.rs", "parse error: unexpected token at line 3")[0]
    assert not judge(None, "rust", "a.rs", "parse error: no Cargo.toml above file")[0]
    assert not judge(None, "rust", "a.rs", None)[0] and not judge(None, "rust", "a.rs", "")[0]
    assert not judge("x = " + "(" * 3000 + "1" + ")" * 3000, "lua", "a.lua", None)[0]
    assert judge("x = " + "(" * 3000 + "1" + ")" * 2999, "lua", "a.lua", None)[0]
    assert not judge("x = 1\n" * 50_000, "lua", "a.lua", None)[0]


@pytest.mark.parametrize("language,text,broken", [
    ('svelte',"<script>let a = 1;</script>\n<p>{'}'}</p>\n{#if a}<b>{a}</b>{:else if a > 2}x{/if}\n{#each xs as {a, b}, i (a)}<i on:click={() => f({a})} class=\"x {a ? \"y\" : 'z'}\" {...rest}/>{/each}\n{@html x}{@const y = {a: 1}}\n<style>a::after { content: '}'; }</style>",False),
    ('svelte',"<p>{a</p>",True),('svelte',"{#if a}<p>{/if}</p>",True),('svelte',"<p>{a +}</p>",True),('svelte',"{#if a}x{/each}",True),('svelte',"<p>a}</p>",True),('svelte','<script lang="ts">let a: number = 1;</script>{a as string}',False),('svelte','<script>let a = 1;</script>{a as string}',True),
    ('svelte',"<style>a { b: c; </style>",True),('svelte',"<a href='x' {b} c={d}>x</a>{#await p then v}{v}{:catch e}{e}{/await}{#key x}a{/key}{#snippet f(a)}b{/snippet}{@render f(1)}",False),
    ('vue',"<template><p :a=\"b\" @click=\"f($event)\">{{ {a: '}}'}.a }}</p></template>\n<script>export default {}</script>",False),('vue',"<template><p>{{ a }</p></template>",True),('vue',"<template><p>a }}</p></template>",True),('vue',"<template><p></template>",True),
    ('javascript',"1 = 2;",True),('javascript',"f() = 3;",True),('javascript',"a?.b = 3;",True),('javascript',"(a) = 1; a.b().c = 2; [a, b.c] = d; ({a} = b); x ??= 1; this.a[0] = 1; new.target; new A().b = 2; async = 3; a = b = c; let f = async x => x = 1;",False),
    ('typescript',"(a as any) = 1; a!.b = 2; a! = 3; (x as Foo).y += 1; f<T>(a).b = 1;",False),
    ('c',"int a;\n#ifdef A\nint b;\n#else\n<<<<<<< HEAD\nint c;\n=======\nint d;\n>>>>>>> x\n#endif\n",True),('c',"int f(void) {\n#ifdef A\n return 1;\n#else\n return ((( 2;\n#endif\n}\n",True),
    ('c',"#ifdef A\nint f(int a) {\n#elif B\nint f(long a) {\n#else\nint f(char a) {\n#endif\n return 0; }\n#ifdef __cplusplus\nextern \"C\" {\n#endif\nint g(void);\n#ifdef __cplusplus\n}\n#endif\n#if 0\nnot 'C ((\n#else\nint h;\n#endif\n",False)
])
def test_markup_targets_and_conditionals(language, text, broken):
    assert (syntax.first_error(text, language, "a." + language) is not None) == broken


@pytest.mark.parametrize("depth", [10, 20_000, 60_000])
def test_deep_nesting_is_parsed_like_any_other(depth):
    nested = "x = " + "(" * depth + "1" + ")" * depth + ";"
    assert syntax.first_error(nested, "javascript", "a.js") is None
    assert syntax.first_error(nested.replace("1", "1 + + *"), "javascript", "a.js") is not None
    assert syntax.first_error(nested + " let 1;", "javascript", "a.js") is not None


@pytest.mark.parametrize("text", ["let a = [1, 2", "const f = (a, {b}) => a ? b : `x${a}`;", "class A { get b() { return 1 } static c = 2; }", "for (const a of b) if (c) d(); else { e }", "x = 1 +", "if (a) { b } }", "async () => { await x; }"])
def test_the_stack_machine_agrees_with_the_compiled_recogniser(text):
    from lodestone.functions.lexers import lex_script

    types, breaks, _ = lex_script(text, False)
    r = syntax._recogniser("javascript")
    assert r.check(types, breaks) == r.machine.check([*types, "EOF"], [*breaks, True])
