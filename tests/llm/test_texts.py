"""Encoding, mixture, prose statistics, documentation pairs and kinds of sources."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import docpairs, mixture, prose, sources, syntax, tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def enc():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Encoder(f.read())


@pytest.fixture(scope="module")
def exact():
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_is_exact(enc, exact, s):
    assert enc.encode_batch([s])[0] == exact(s)


@pytest.mark.parametrize("s", ["a" * 4000, " " * 3000 + "x", "\n\t" * 500, "<|endoftext|>", "ab" * 900 + "é" * 50, "日本語" * 200, "the " * 2000])
def test_long_and_odd_texts(enc, exact, s):
    assert enc.encode_batch([s])[0] == exact(s)


def test_encoding_frames(spark, enc):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (4, "a b", "x")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(d).collect()}
    ab = enc.encode_batch(["a b"])[0]
    assert got == {1: ab, 2: [], 3: [], 4: ab} and tokens.encode(d.limit(0)).count() == 0
    assert {r.doc_id: r.tokens for r in tokens.encode(d, count_only=True).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}


def test_pivot_keeps_sizes_and_expectations():
    rnd = random.Random(1)
    size = [rnd.randint(1, 50) for _ in range(400)]
    taken = [0] * 400
    for seed in range(300):
        out, held, p = mixture.pivot([0.3] * 400, size, list(range(400)), seed)
        assert sum(x is None for x in out) <= 1
        total = sum(s * (x or 0) for s, x in zip(size, out)) + (size[held] * p if held is not None else 0)
        assert abs(total - 0.3 * sum(size)) < 1e-3
        for i, x in enumerate(out):
            taken[i] += p if i == held else x or 0
    share = [t / 300 for t in taken]
    assert abs(sum(share) / 400 - 0.3) < 0.02 and max(share) < 0.45 and min(share) > 0.15
    assert mixture.pivot([0.0, 1.0], [1, 1], [1, 2], 0)[0] == [0, 1] and mixture.pivot([], [], [], 0) == ([], None, 0.0)


def test_mixture(spark):
    rnd = random.Random(2)
    rows = [(i, "word " * rnd.randint(1, 40) + str(i), rnd.choice(["big"] * 8 + ["small"])) for i in range(3000)]
    rows += [(9000 + i, "the same text", "small") for i in range(50)] + [(9100, None, "big"), (9101, "", "big"), (9102, "x y", None), (9103, "x y", "unlisted"), (9104, "long " * 4000, "big")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats int")
    sized = mixture.sized_texts(d, t)
    assert sized.where("doc_id >= 9000 and doc_id < 9100").count() == 1 and sized.where("doc_id in (9100, 9101, 9102, 9103)").count() == 0
    q = mixture.quotas(sized, t)
    mixed = mixture.mix(sized, q)
    r = {x.source: x for x in mixture.shares(mixed, q).collect()}
    assert abs(r["big"].actual_share - 0.5 / 0.9) < 0.005 and r["none"].tokens == 0
    assert r["small"].most_copies <= 2 and r["big"].most_copies <= 1 and mixed.select("doc_id").distinct().count() == mixed.count()
    assert mixed.agg(F.sum("tokens")).first() == mixture.mix(sized, q).agg(F.sum("tokens")).first()  # a rerun draws the same
    empty = mixture.sized_texts(d.limit(0), t)
    assert mixture.mix(empty, mixture.quotas(empty, t)).count() == 0


PROSE = [
    "When you open a large repository, the symbol is read first and the page only on\ndemand. Note that `trace_delta` does not touch the binding; it only marks\nthe trait as cold.",
    "if\nthe module has been renamed, the old node stays in the table until the next\nsweep\nfor a small workspace all of this fits in memory, so the order of the rows does not matter",
    "Das node wird neu gebaut, sobald sich ein bucket geändert hat. Für kleine Projekte ist die Reihenfolge gleichgültig.",
    "`a_b` calls `c_d`, which hands `E::f` over to `g_h`. Since revision 55, `x_y` returns `Z::q` instead of `P::r`.",
    "- The symbol is rebuilt whenever the label changes, which is why a cold run takes longer.\n- We tried to cache every node, but the stale entries were never hit.",
    "索引已更新。如果模块已被重命名，旧节点会保留在表中直到下一次清理。",
    "No hace falta leer el export dos veces, porque el scope sigue igual.",
]
OTHER = [
    "| a | b |\n| --- | --- |\n| frontier | not yet |\n| x | to be seen |", "name,head,stop\npath,in part,not yet\ntoken,to be seen,no", "a\tb\tc\nto be seen\tno\tin part\nx\ty\tz",
    "+-----+-----+\n| a   | b   |\n+-----+-----+", "acc       count     width\nscope     more than before   no\nbody      cold      57.1\nedge      stale     81.2",
    "- raw comment\n- `join_label`\n- early token\n- orphan origin", "from the label to the suffix\nwhat is in a symbol and what is not\nhow to emit the trait\nall of the above but for the peer\nwhen the manifest is cold",
    "    at walkIndent (sync/indent.ts:442:76)\n    at releaseTrait (lookup/queue.ts:115:42)", "2026-01-17T00:11:44Z INFO [token] id=52229 nodes=33\n2026-06-03T06:27:23Z ERROR [symbol] id=52906 buffer=95",
    "```rust\nlet a = b.iter().filter(|x| x.depth > 3).count();\nwhile let Some(n) = q.pop() { v.push(n); }\n```", "scope scope scope scope scope scope scope scope scope scope scope scope",
    "binding what any they been page as manifest module than on but cursor or.\nno would you it a export on will.\nfor to it is bucket or body than has.\na was to indent label our but an only by how token.",
    "ykwfobgvprlbeezagrjcfozj\ncgdohhoehetiweodezltrtudqczdzsxmgd", "Home | Docs | Queue | Cache | Search | Sign in | Next »\nHome | Docs | Index | Planner | Search | Sign in | Next »",
    "!!~^-@=$!>{ /<?\\-*!<*:=&}=;;><?)< >.*/{/@||]/>/;/+(:{<!!.[", "sync/a.ts, Loader / b, `c_d`, core::e::F::g, primary h, stale i, x::Y::z",
]


@pytest.mark.parametrize("t", PROSE)
def test_prose(t):
    p, _, _, n = prose.prose_chars(t)
    assert p >= 0.9 * n


@pytest.mark.parametrize("t", OTHER)
def test_not_prose(t):
    p, _, _, n = prose.prose_chars(t)
    assert p <= 0.2 * n


def test_statistics_frames(spark):
    d = spark.createDataFrame([(1, PROSE[0], "en"), (2, OTHER[0], None), (3, None, "en"), (4, "", "en"), (5, " \n\t ", "xx"), (6, PROSE[0] + " " + "x" * 200_000, "EN-us")], "doc_id bigint, text string, lang string").withColumn("words", F.lit("clash"))
    w = spark.createDataFrame([("en", "the"), ("en", "a"), (None, "x"), ("de", None)], "lang string, word string")
    s = {r.doc_id: r for r in prose.text_statistics(d, w).collect()}
    assert s[3].words is None and s[4].words == 0 and s[5].prose_share == 0.0 and s[1].prose_share > 0.9 and s[2].table_share > 0.9
    assert 0 < s[1].common_share < 0.5 and s[1].mean_word_length > 3
    assert {r.doc_id for r in prose.not_prose(prose.text_statistics(d, w)).collect()} == {2, 6}
    assert prose.text_statistics(d.limit(0), w.limit(0)).count() == 0
    assert prose.autocorrelation([40, 40, 41]) == 1.0 and prose.autocorrelation([1]) == 0.0


SAYS = ["Never blocks.", "Sorts in place.", "@returns how many symbols were kept", "TODO\nRuns in O(n log n).", "/// # Errors\n///\n/// Fails when the node is gone.", "Liefert leer zurueck, falls das node zu keinem anchor passt.", "Split span. Returns -1 if absent.", "Panics on an empty prefix. TODO: cover the raw case too.", "清空缓存并返回数量", "@param limit the first node to start from", "@deprecated Use the streaming reader, this one loads all rows."]
EMPTY = ["", " \n", None, "TODO", "FIXME: later", "N/A", "-----", "***", "No description.", "(no documentation)", "@internal", "@see other", "{@inheritDoc}", "See above.", "See the node documentation for details and the changelog for its history.", "@param a\n@returns", "@param a a\n@returns the return value", "Split span.", "The split span.", "`split_span`", "split_span()", "This is the `split_span` function.", "Splits the span helper.", "Function split_span.", "This function is called `split_span` and lives in this file, please document it when there is time.", "Owner: span group, reviewed in round 4, ticket 4821.", "Provided as is under the Larkspur terms, see the LICENCE file of the distribution.", "Copyright (c) the authors", "eslint-disable-next-line no-console", "<!-- -->", "#region", "Noch zu beschreiben.", "À documenter plus tard", "Auto-generated method stub", " * n/a"]


@pytest.mark.parametrize("t", SAYS)
def test_says_something(t):
    assert docpairs.says_something(t, "split_span")


@pytest.mark.parametrize("t", EMPTY)
def test_says_nothing(t):
    assert not docpairs.says_something(t, "split_span") and not docpairs.says_something(t, "splitSpan")


def test_functions_and_comments():
    rs = "/// Never blocks.\n#[inline]\npub fn a(x: u8) -> u8 { if x > 1 { \"}\" } else { '}' } }\n\n\n\n/// Lost.\n\n\n\nfn b() {}\n"
    f = docpairs.functions(rs, "rust")
    assert [(n, d) for n, _, _, d in f] == [("a", "/// Never blocks."), ("b", None)] and rs[f[0][1] : f[0][2]].endswith("} }")
    lu = "--- Doc.\n-- luacheck: ignore\nfunction M.a(x)\n  for i = 1, 2 do if x then end end\n  return function() end\nend\nlocal function b() end"
    g = docpairs.functions(lu, "lua")
    assert [(n, d) for n, _, _, d in g] == [("M.a", "--- Doc."), ("b", None)] and lu[g[0][1] : g[0][2]].count("end") == 4
    ts = "class A {\n  /**\n   * Doc.\n   */\n  // eslint-disable-next-line x\n  private async m(a: Map<string, number>, b = 0): Promise<void> {\n    if (a) { return }\n  }\n}\n"
    assert [(n, d is not None) for n, _, _, d in docpairs.functions(ts, "typescript")] == [("m", True)]
    assert [n for n, *_ in docpairs.functions("static void f(const char * a, int b)\n{\n  if (a) { g(); }\n}\n", "c")] == ["f"]
    py = "def a():\n    x\n\n    y\nz\n"
    assert py[slice(*docpairs.functions(py, "python")[0][1:3])] == "def a():\n    x\n\n    y\n"


def test_pairs(spark):
    b = spark.createDataFrame([
        ("w", "m::a", "a.rs", "/// Never blocks.\nfn a() {}"), ("w", "m::a", "a.rs", "/// Never blocks.\nfn a() {}"), ("w", "m::b", "b.rs", "fn b() {}"), ("w", "m::c", "c.rs", "/// TODO\nfn c() {}"), ("w", "m::d", "d.rs", None), ("w", "m::e", "e.rs", "  \n"), ("w", "m::T", "t.rs", "/// Says much more.\nstruct T {}"), ("v", "m::b", "b.rs", "fn b() {"), (None, "m::n", None, "fn n() {}")],
        "workspace_id string, fqdn string, file string, body string").withColumn("description", F.lit("clash"))
    s = spark.createDataFrame([("w", f"m::{x}", "callable") for x in "abcde"] + [("w", "m::T", "type"), ("v", "m::b", "callable"), ("w", None, "callable"), ("w", "m::q", None)], "workspace_id string, fqdn string, kind string")
    d = spark.createDataFrame([("w", "m::b", "B."), ("w", "m::b", "Sorts in place."), ("w", "m::b", None), ("w", "m::d", "Sorts in place."), ("w", "m::x", "Sorts in place."), ("w", None, "x")], "workspace_id string, symbol_fqdn string, description string")
    assert {tuple(r) for r in docpairs.documented(b, s, d).collect()} == {("w", "m::a"), ("w", "m::b")}
    p = {r.fqdn: r for r in docpairs.pairs(b, s, d).collect()}
    assert p["m::a"].code == "fn a() {}" and p["m::a"].from_body and p["m::b"].description == "Sorts in place." and not p["m::b"].from_body
    assert docpairs.pairs(b.limit(0), s.limit(0), d.limit(0)).count() == 0


def test_source_signals():
    assert sources.place("a/vendor/b.rs")[0] and not sources.place("a/vendoring/b.rs")[0] and not sources.place("src/external_links/a.ts")[0]
    assert sources.place("ws:1:a/node_modules/x.js")[0] and sources.place("a/x.min.js")[1] and sources.place("a/target/debug/build/q/out/q.rs")[1] and sources.place("a/x_generated.c")[1]
    assert not sources.place("src/generator/a.rs")[1] and not sources.place("src/generated_names.rs")[1] and not sources.place("src/minify.ts")[1]
    own = frozenset(["core", "ui"])
    assert sources.notice("// Code generated by x. DO NOT EDIT.\nfn a() {}", "core", own) == (True, False)
    assert sources.notice("/*\n * Copyright (c) the core authors\n * Part of core, see LICENCE.\n */", "core", own) == (False, False)
    assert sources.notice("// Copyright (c) the zlibby authors\n", "core", own) == (False, True)
    assert sources.notice("// Imported from zlibby release 3.8; local changes: none\n", None, own) == (False, True)
    assert sources.notice("fn a() { /* generated by x */ }", "core", own) == (False, False)
    kinds = lambda t, lang: sources.verdict(sources.layout(t, lang), lang)
    assert kinds("var a=function(b){return b+1};" * 60, "javascript")[0]
    assert kinds("pub const A: [u8; 9] = [\n" + "    0x31, 0xe5, 0x3b, 0xc8,\n" * 20 + "];\n", "rust")[1]
    assert kinds("export const T = [\n" + "".join(f"  {{ id: {i}, w: {i * 7}, s: 'a{i}' }},\n" for i in range(20)) + "];\n", "typescript")[1]
    assert kinds("export const T = '" + "aB3+" * 300 + "';\n", "typescript")[1]
    assert kinds("fn get_field_1() {}\nfn set_field_2() {}\nfn has_field_3() {}\n", "rust")[2]
    assert kinds("fn parse(a: u8) -> u8 {\n    let b = a + 1;\n    b\n}\n", "rust") == (False, False, False) and kinds("", "rust") == (False, False, False)


def test_not_handwritten(spark):
    body = "fn walk(a: &[u32], depth: usize) -> usize {\n    let mut n = 0;\n    for x in a { if *x > 3 { n += depth; } }\n    n\n}\n\nfn other(q: &str) -> bool { q.len() > 3 && q.starts_with(\"abc\") && !q.ends_with(\"xyz\") && q != \"none\" }\n"
    f = spark.createDataFrame([
        ("core/src/a.rs", "// own\n" + body, "rust", False), ("core/vendor/z/a.rs", body, "rust", None), ("core/src/b.rs", "fn solo() { println!(\"nothing to see here at all, really nothing to see\"); }\n", "rust", None), ("core/src/c.rs", None, None, True), ("core/src/d.rs", None, "rust", None), ("core/src/e.rs", "", "rust", False), ("core/src/f.rs", None, "rust", False), (None, "x", "rust", True), ("core/src/b.rs", "fn solo() {}\n", "rust", None)],
        "path string, content string, language string, is_external boolean").withColumn("digest", F.lit(1))
    s = spark.createDataFrame([("core/src/d.rs", True, None), ("core/src/d.rs", False, "cargo_registry"), ("core/src/b.rs", True, "workspace"), ("core/src/b.rs", None, None), ("core/src/f.rs", True, None), (None, True, None)], "file_path string, is_external boolean, source_origin string")
    p = spark.createDataFrame([("/c/primary/core", "core")], "root_path string, label string")
    w = spark.createDataFrame([("primary", "/c/primary")], "workspace_id string, root_path string")
    got = {r.path: (r.foreign, r.copied) for r in sources.not_handwritten(f, s, p, w).collect()}
    assert got == {"core/src/a.rs": (False, True), "core/vendor/z/a.rs": (True, False), "core/src/c.rs": (True, False), "core/src/d.rs": (True, False)}
    assert sources.not_handwritten(f.limit(0), s.limit(0), p.limit(0), w.limit(0)).count() == 0


def test_syntax_frames(spark):
    f = spark.createDataFrame([("ws:1:a/x.rs", "h", "fn f() {", "Rust", 1, None), ("ws:1:a/x.rs", "h", "fn f() {", "Rust", 1, None), ("ws:1:a/y.rs", "i", "fn f() {}", "rs", None, "syntax error"), ("q.lua", None, None, "lua", 1, "unfinished string near '\"'"), (None, "k", "x", None, None, None)], "path string, content_hash string, content string, language string, project_id bigint, last_scan_error string").withColumn("broken", F.lit("clash"))
    j = syntax.parsed(f)
    assert {(r.path, r.content_hash) for r in j.where("broken").collect()} == {("ws:1:a/x.rs", "h"), ("q.lua", None)}
    pre = spark.createDataFrame([("ws:1:a", "proj")], "prefix string, label string")
    assert {(r.label, r.language): (r.versions, r.broken) for r in syntax.rates(j, pre).collect()} == {("proj", "rust"): (2, 1), (None, "lua"): (1, 1), (None, None): (1, 0)}
    assert syntax.rates(syntax.parsed(f.limit(0)), pre).count() == 0


def test_listings_without_bullets():
    unit = ("Shows how the new parser reads each table of the report", "Keeps what the old reader found in most of the folders")
    even = "\n".join(unit * 3)
    periodic = "\n".join(f"{a}\n    {b} and then writes all of it to the shared disk" for a, b in [unit] * 3)
    for t in (even, periodic):
        p, _, lists, n = prose.prose_chars(t)
        assert p == 0 and lists == n
    wrapped = "The reader keeps what it found in most of the folders, and then\nit writes all of it to the shared disk, where the parser of the\nreport looks for it again. Nobody has to wait for the others to\nfinish, because each of them works on a table of its own now."
    p, _, lists, n = prose.prose_chars(wrapped)
    assert p > 0.9 * n and lists == 0
    assert prose.indent_period(["a", "  b", "a", "  b"]) == 2 and prose.indent_period(["a", "b", "c", "d"]) == 0 and prose.indent_period(["  a", "b", "c", "d"]) == 0


@pytest.mark.parametrize("language,text,want", [
    ("typescript", "const f = (x) => x + 1;\nfunction g() { return {a: 1}; }\n", ["const f = (x) => x + 1;", "function g() { return {a: 1}; }"]),
    ("typescript", "const h = y =>\n  y\n    .map(z => ({a: z}))\nfunction g(): { a: number } { return '}'; }\nlet q = 1;", ["const h = y =>\n  y\n    .map(z => ({a: z}))", "function g(): { a: number } { return '}'; }"]),
    ("rust", "trait T {\n    fn decl(&self) -> u8;\n    fn next(&self) -> [u8; 4] { [0; 4] }\n}\n", ["fn decl(&self) -> u8;", "fn next(&self) -> [u8; 4] { [0; 4] }"]),
    ("c", "static int f(int a) {\n  /* } */ return a; }\nint g(void) { }", ["static int f(int a) {\n  /* } */ return a; }", "int g(void) { }"]),
    ("typescript", "function f(a) {\n  const r = /[{(]x/.test(a);\n  log('a } b');\n}\n", ["function f(a) {\n  const r = /[{(]x/.test(a);\n  log('a } b');\n}"]),
])
def test_bodies_end_where_their_marks_close(language, text, want):
    assert [text[a:b] for _, a, b, _ in docpairs.functions(text, language)] == want


def test_layout_of_each_language_and_short_copies(spark):
    base64 = "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5ejAxMjM0NTY3ODk" * 12
    words = " ".join(f"word{i}" for i in range(200))
    assert sources.verdict(sources.layout(f"const T = /{words.replace(' ', 'X')}/;\n", "typescript"), "typescript")[1]  # letters only, one long line
    assert sources.verdict(sources.layout(f'let x = "{base64}";\n', "rust"), "rust")[1]
    dense = "var a=[(b+c)*d,{e:f}];if(!g){h(i,j)||k&&l}" * 30
    assert sources.verdict(sources.layout(dense, "javascript"), "javascript")[0] and not sources.verdict(sources.layout("let a = 1;\n" * 5, "javascript"), "javascript")[0]
    assert set(sources.LAYOUT) >= {"rust", "typescript", "javascript", "lua", "c", "vue", "svelte"}
    short = "int twice(int a) {\n  return 2 * a;\n}\n"
    files = spark.createDataFrame([("vendor/t.c", short, "c", True), ("src/mine.c", "/* own words */\n" + short, "c", None), ("src/other.c", short.replace("2", "3"), "c", None)], "path string, content string, language string, is_external boolean")
    none = spark.createDataFrame([], "file_path string, is_external boolean, source_origin string")
    projects, ws = spark.createDataFrame([], "root_path string, label string"), spark.createDataFrame([], "workspace_id string, root_path string")
    got = {r.path: r.copied for r in sources.not_handwritten(files, none, projects, ws).collect()}
    assert got == {"vendor/t.c": False, "src/mine.c": True}

#: Plain sentences in languages whose function words aren't known, and one without punctuation and capitals.
ELSEWHERE = [
    "Program ini membaca semua berkas dari folder dan menyimpan hasilnya. Jika berkas tidak ada, program akan berhenti dengan pesan kesalahan. Kami akan memperbaiki masalah itu minggu depan.",
    "Ten program czyta wszystkie pliki z katalogu i zapisuje wyniki do bazy danych. Nie wiemy jeszcze, dlaczego proces zatrzymuje sie po kilku minutach. Prosze sprawdzic ustawienia przed uruchomieniem.",
    "Ohjelma lukee kaikki tiedostot hakemistosta ja tallentaa tulokset tietokantaan. En tieda miksi prosessi pysahtyy muutaman minuutin kuluttua. Tarkista asetukset ennen kaynnistamista.",
    "Programu hii inasoma faili zote kutoka kwenye folda na kuhifadhi matokeo. Kama faili haipo, programu itasimama na kuonyesha ujumbe wa kosa. Tutarekebisha tatizo hilo wiki ijayo.",
    "Program klasordeki tum dosyalari okur ve sonuclari veritabanina kaydeder. Dosya yoksa program bir hata mesajiyla durur.",
    "program ini membaca semua berkas dari folder dan menyimpan hasilnya jika berkas tidak ada program akan berhenti dengan pesan kesalahan",
    "wij hebben lang gezocht, maar de fout zat in een oud span\nwie een groot project\nopent, ziet eerst alleen het indent\nhet token wordt\nopnieuw gebouwd zodra het lockfile verandert",
]
LISTS = [
    "Cache Ledger Table\nFormatter Index Pool\nMatcher Visitor Walker\nSession Router Planner\n",
    "lazy column\nraw manifest\n`score_peer`\nheader::Ledger::strip_anchor\nIndex / glob\ndefault origin\nhidden import.",
    "* when the trait is default\n* all of the above but for the label\n* by catalog, by export\n* how to visit the module\n* what is in a page and what is not\n* the lazy queue and its peer",
    "all of the above but for the scope\nby indent, by suffix\nby project, by edge\nfrom the receiver to the bucket\nthe hidden receiver and its workspace\nall of the above but for the label\nwhat is in a page and what is not",
]


@pytest.mark.parametrize("t", ELSEWHERE)
def test_prose_of_unknown_languages(t):
    p, _, _, n = prose.prose_chars(t)
    assert p >= 0.9 * n


@pytest.mark.parametrize("t", LISTS)
def test_lists_by_layout(t):
    p, _, _, n = prose.prose_chars(t)
    assert p < 0.3 * n


def test_layout_measures():
    assert prose.wrapped(["aaaa bbbb cccc", "dddd eeee ffff", "gg"]) == 1.0 and prose.wrapped(["a", "b"]) == 1.0 and prose.wrapped(["x"]) == 0.0
    assert prose.indent_period(["a", "  b", "a", "  b"]) == 2 and prose.indent_period(["a", "b", "c", "d"]) == 0
    assert prose.unlike_prose(["!!~^-@=$!>{ /<?\\-*!<*:=&}="]) and not prose.unlike_prose(["a plain line of words"])
    assert prose.prose_chars("") == (0, 0, 0, 0) and prose.prose_chars(" \n ")[0] == 0
