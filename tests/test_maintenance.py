"""Incremental maintenance, sources, streaming and extraction."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract
from lodestone.operators import incremental as inc
from lodestone.operators.order import dense_ids
from lodestone.operators.similar import did_you_mean, name_scores
from lodestone.sources import workspace
from lodestone.streaming import live


def test_upsert_delete_replace(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None), (2, "b", None), (None, "n", 1)], "k int, v string, p int")
    new = spark.createDataFrame([(2, "B", 7), (3, "c", None)], "k int, v string, p int")
    assert {tuple(r) for r in inc.upsert(old, new, ["k"]).collect()} == {(1, "a", 5), (2, "B", 7), (3, "c", None), (None, "n", 1)}
    kept = inc.upsert(old, new.withColumn("p", F.lit(9)).unionByName(spark.createDataFrame([(1, "A", 8)], "k int, v string, p int")), ["k"], keep=("p",))
    assert {tuple(r) for r in kept.collect()} == {(1, "A", 5), (2, "B", 9), (3, "c", 9), (None, "n", 1)}
    assert {r.k for r in inc.delete_by(old, new, ["k"]).collect()} == {1, None}
    assert sorted(r.k for r in inc.replace_by(old, new, ["k"], touched=spark.createDataFrame([(1,)], "k int")).where("k is not null").collect()) == [2, 2, 2, 3]
    assert inc.upsert(old.limit(0), new.limit(0), ["k"]).count() == 0
    w = spark.createDataFrame([("x", 2, "late"), ("x", 1, "first")], "k string, o int, v string")
    assert [tuple(r) for r in inc.first_write_wins(w, ["k"], ["o"]).collect()] == [("x", 1, "first")]


def test_diff_buckets(spark):
    sc = "fqdn string, body_hash string, start_line int, start_col int, end_line int, end_col int"
    a = spark.createDataFrame([("same", "h", 1, 0, 2, 0), ("moved", "h", 1, 0, 2, 0), ("edited", "h", 1, 0, 2, 0), ("gone", "h", 1, 0, 2, 0), ("set", None, 1, 0, 2, 0)], sc)
    b = spark.createDataFrame([("same", "h", 1, 0, 2, 0), ("moved", "h", 5, 0, 6, 0), ("edited", "x", 1, 0, 2, 0), ("fresh", "h", 1, 0, 2, 0), ("set", "h", 1, 0, 2, 0)], sc)
    assert {r.fqdn: r.change for r in inc.diff(a, b, ["fqdn"]).collect()} == {"same": "same", "moved": "position", "edited": "modify", "gone": "delete", "fresh": "insert", "set": "modify"}


def test_apply_files_keeps_revisions_of_unchanged_symbols(spark):
    sc = "workspace_id string, fqdn string, file_path string, body_hash string, last_modified_revision bigint"
    ec = "workspace_id string, from_fqdn string, target string"
    s = spark.createDataFrame([("p", "a", "f", "1", 1), ("p", "b", "f", "1", 1), ("p", "c", "g", "1", 1), ("p", "gone", "f", "1", 1)], sc)
    e = spark.createDataFrame([("p", "a", "old"), ("p", "c", "keep"), ("p", "gone", "x")], ec)
    ns = spark.createDataFrame([("p", "a", "f", "1", None), ("p", "b", "f", "2", None)], sc)
    ne = spark.createDataFrame([("p", "a", "new")], ec)
    s2, e2 = inc.apply_files(s, e, ns, ne, spark.createDataFrame([("f",)], "file_path string"), 9)
    assert {(r.fqdn, r.last_modified_revision) for r in s2.collect()} == {("a", 1), ("b", 9), ("c", 1)}
    assert {(r.from_fqdn, r.target) for r in e2.collect()} == {("a", "new"), ("c", "keep")}


@pytest.mark.parametrize("layers,path,want", [
    ([("", ["*.log"])], "a/b.log", True), ([("", ["*.log", "!keep.log"])], "a/keep.log", False), ([("", ["build/"])], "a/build/x.rs", True), ([("", ["build/"])], "build", False),
    ([("", ["/build"])], "a/build/x", False), ([("", ["a/**/z"])], "a/b/c/z", True), ([("", ["a/*.rs"])], "a/b/c.rs", False), ([("", ["*.rs"]), ("a", ["!*.rs"])], "a/x.rs", False),
    ([("", ["*.rs"]), ("a", ["!*.rs"])], "b/x.rs", True), ([("", ["# c", ""])], "c", False), ([("", ["a?c"])], "a/c", False), ([], "x", False)])
def test_ignore_rules(spark, layers, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(inc.ignored(F.col("p"), layers)).first()[0] is want


def test_staleness_recent_use_and_last_good(spark):
    s = spark.createDataFrame([("a", 5), ("b", 9), ("b", 3)], "fqdn string, last_modified_revision bigint")
    r = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("a", None)], "fqdn string, fetched_at bigint")
    assert sorted((x.fqdn, x.fetched_at or 0, x.state) for x in inc.staleness(r, s).collect()) == [("a", 0, "stale"), ("a", 5, "fresh"), ("b", 5, "stale"), ("c", 5, "missing")]
    e = spark.sql("select id, u, timestamp_seconds(t) ts from values (1,'x',1000),(2,'x',1300),(3,'x',1601),(4,'y',1000),(5,'x',1601),(6,null,1),(7,null,2),(8,'z',null) as v(id,u,t)")
    assert {r.id for r in inc.recent_use(e, "u", "ts").where("recent").collect()} == {2}
    v = spark.createDataFrame([("f", "1", None, 1), ("f", "2", "bad", 2), ("g", "1", "bad", 1), ("h", "1", "bad", 1), ("h", "2", "", 2)], "path string, content_hash string, last_scan_error string, last_scanned_ms bigint")
    assert {r.path: (r.content_hash, r.good_hash) for r in inc.last_good(v).collect()} == {"f": ("2", "1"), "g": ("1", None)}


def test_similar_blocks(spark, monkeypatch):
    names = spark.createDataFrame([("parse_file",), ("parseFile",), ("parse_files",), ("zzz",), ("",), (None,)], "name string")
    from lodestone.operators import similar

    monkeypatch.setattr(similar, "BLOCK", 2)
    got = {(r["query"], r["name"]) for r in name_scores(names, names, 0.6).collect()}
    from lodestone.functions.text import similarity

    plain = ["parse_file", "parseFile", "parse_files", "zzz", ""]
    assert got == {(a, b) for a in plain for b in plain if a.lower() != b.lower() and similarity(a, b) >= 0.6}
    s = spark.createDataFrame([("m::parse_file", "parse_file")], "fqdn string, name string")
    assert [r.fqdn for r in did_you_mean(spark.createDataFrame([("*parse_fil?",), ("parse_file",)], "name string"), s).collect()] == ["m::parse_file"]


def test_best_names_are_found_over_all_names(spark):
    """A slice is as large as memory allows, not a share of the shuffle partitions: what a query keeps doesn't grow with those."""
    names = spark.range(400).selectExpr("concat('parse_', substr(md5(cast(id as string)), 1, 6)) as name")
    asked = spark.createDataFrame([("parse_file",), ("crates::front::parse::" * 4 + "parse_abc123",)], "name string")
    from lodestone.functions.text import similarity

    plain = [r.name for r in names.collect()]
    got = {(r["query"], r["name"]): r["score"] for r in name_scores(asked, names, 0.6, 5).collect()}
    for q in (r.name for r in asked.collect()):
        scores = sorted((similarity(q, x) for x in plain if similarity(q, x) >= 0.6), reverse=True)
        least = scores[4] - 2e-6 if len(scores) > 4 else 0.6
        assert {k: v for k, v in got.items() if k[0] == q} == {(q, x): similarity(q, x) for x in plain if similarity(q, x) >= least}


@pytest.mark.parametrize("seed", range(3))
def test_ready_names_equal_plain_scores(seed):
    from lodestone.functions.text import similarity
    from lodestone.operators.similar import Names

    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeABC_12é.ſİ\0aaaaaaaa", k=rng.choice([0, 1, 2, 3, 5, 8, 13, 20, 40, 63, 64, 65, 90])))
    names = list(dict.fromkeys(word() for _ in range(120)))
    rows = [rng.randint(1, 5) for _ in names]
    ready = Names(names, rows)
    for q in [*names[:30], *(word() for _ in range(20))]:
        full = {x: v for x in names if x.lower() != q.lower() and (v := similarity(q, x)) >= 0.6}
        for top in (None, 1, 5, 20):
            at, score = ready.best(q, 0.6, top)
            got = dict(zip(ready.names[at], score))
            all_rows = sorted((v for x, v in full.items() for _ in range(rows[names.index(x)])), reverse=True)
            least = 0.6 if top is None or len(all_rows) < top else all_rows[top - 1]
            assert len(got) == len(at) and {x for x, v in full.items() if v >= least} <= got.keys() <= full.keys()
            assert all(abs(got[x] - full[x]) < 1e-12 for x in got)


def test_hot_name_sends_few_rows(spark, monkeypatch):
    """A name that many symbols have: only its first paths can be among the best."""
    from lodestone.operators import similar

    s = spark.range(500).selectExpr("concat('m::', lpad(id, 3, '0')) as fqdn", "if(id = 250, 'parse_filed', 'parse_files') as name")
    seen = []
    monkeypatch.setattr(similar, "name_scores", lambda q, n, *x: seen.append(n.count()) or name_scores(q, n, *x))
    got = similar.similar_symbols(spark.createDataFrame([("parse_file",), ("parse_filed",)], "name string"), s, 0.6, 3).collect()
    assert seen == [4]
    assert {(r["query"], r["rank"]): r.fqdn for r in got} == {(q, k + 1): f"m::00{k}" for q in ("parse_file", "parse_filed") for k in range(3)}


def test_dense_ids(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    rows = dense_ids(d, ["v"]).orderBy("v").collect()
    assert [r.id for r in rows] == list(range(1000))


def test_walk_projects_and_config(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_text("fn a() {}\n")
    (tmp_path / "src/b.py").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("y")
    w = workspace.walk(spark, str(tmp_path), [("", ["node_modules/"])]).collect()
    assert [(r.path, r.language, r.content) for r in w] == [("src/a.rs", "rust", "fn a() {}\n")]
    p = spark.createDataFrame([("Cargo.toml",), ("ext/vscode/package.json",), ("ext/vscode/tsconfig.json",), ("x/y.rs",)], "path string")
    assert {(r.rel_path, r.kind, r.label) for r in workspace.discover_projects(p).collect()} == {("", "rust", "root"), ("ext/vscode", "node", "vscode")}
    c = workspace.parse_config('ignore {\n  target/ # built\n  *.min.js\n}\nproject "core" "crates/core" { kind = "rust" }\ngroup "all" {\n core\n ui\n}\n')
    assert c["ignore"] == ["target/", "*.min.js"] and c["project"][0]["args"] == ["core", "crates/core"] and c["project"][0]["kind"] == "rust"
    assert {tuple(r) for r in workspace.config_groups(spark, c).collect()} == {("all", "core"), ("all", "ui")}
    with pytest.raises(ValueError):
        workspace.parse_config("ignore {")
    x = spark.createDataFrame([("cargo", True, "a::b", "f.rs"), ("npm", False, None, None)], "provider string, available boolean, fqdn string, file_path string")
    q = spark.createDataFrame([("cargo", "a::b"), ("cargo", "z"), ("npm", "q"), ("lua", "q")], "provider string, fqdn string")
    assert {(r.provider, r.fqdn): r.status for r in workspace.external_lookup(q, x).collect()} == {("cargo", "a::b"): "resolved", ("cargo", "z"): "not_found", ("npm", "q"): "missing_binary", ("lua", "q"): "missing_binary"}


def test_stream_applies_every_drop_once(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "snap")
    sc = "path string, h string, ms bigint"
    spark.createDataFrame([("a", "1", 1), ("b", "1", 1)], sc).coalesce(1).write.parquet(f"{src}/d1")
    schema = spark.read.parquet(f"{src}/d1").schema
    for _ in range(2):
        live.follow(spark, f"{src}/*", schema, base, ["path"], ["ms", "h"], trigger={"availableNow": True}).awaitTermination()
        assert {tuple(r) for r in live.snapshot(spark, base, schema).collect()} == {("a", "1", 1), ("b", "1", 1)}
    spark.createDataFrame([("a", "2", 5), ("b", "0", 0), ("c", "1", 1)], sc).coalesce(1).write.parquet(f"{src}/d2")
    live.follow(spark, f"{src}/*", schema, base, ["path"], ["ms", "h"], trigger={"availableNow": True}).awaitTermination()
    assert {tuple(r) for r in live.snapshot(spark, base, schema).collect()} == {("a", "2", 5), ("b", "1", 1), ("c", "1", 1)}


def test_commands(spark):
    rows = spark.createDataFrame([("a", "1", None), ("b", "1", None)], "path string, h string, last_scan_error string")
    cmd = spark.createDataFrame([("a", "2", None, "upsert", 1), ("b", None, None, "delete", 2), ("b", "9", None, "upsert", 1), ("c", "1", None, "upsert", 1), ("a", None, None, "noop", 0)], "path string, h string, last_scan_error string, op string, seq int")
    assert {tuple(r) for r in live.apply_commands(rows, cmd, ["path"]).collect()} == {("a", "2", None), ("c", "1", None)}
    err = spark.createDataFrame([("a", None, "bad", "error", 1)], "path string, h string, last_scan_error string, op string, seq int")
    assert ("a", "1", "bad") in {tuple(r) for r in live.apply_commands(rows, err, ["path"]).collect()}


def rows(path, text, module="m", what="symbol"):
    return [r for r in extract.extract_text(path, text, module) if r["what"] == what]


def test_extract_rust():
    src = "/// Says hello.\n#[derive(Clone, Nope)]\npub struct A { pub x: Vec<u8>, y: i32 }\nimpl Show for A {\n    fn go(&self, b: &B) -> u8 { self.stop(); b.run(); free(1); p::q(); println!(\"{}\", x); }\n}\nuse crate::util::{self, Foo as F, *};\npub use super::Z;\n#[no_mangle]\npub extern \"C\" fn main() {}\nextern \"C\" { fn puts(s: u8); }\n"
    s = {(r["fqdn"], r["language_kind"]) for r in rows("a.rs", src)}
    assert {("m", "module"), ("m::A", "struct"), ("m::A::x", "field"), ("m::A::go", "impl_fn"), ("m::Z", "re_export"), ("m::main", "fn")} <= s
    e = {(r["kind"], r["target"], r.get("receiver_type")) for r in rows("a.rs", src, what="edge")}
    assert {("CALLS", "stop", "A"), ("CALLS", "run", "B"), ("CALLS", "m::free", None), ("CALLS", "p::q", None), ("CALLS", "println", None), ("IMPLEMENTS", "Show", None), ("IMPLEMENTS", "<builtin>::rust::Clone", None), ("IMPORTS", "m::util", None), ("IMPORTS", "m::util::Foo", None)} <= e
    assert ("m::A", "Says hello.") in {(r["fqdn"], r["target"]) for r in rows("a.rs", src, what="doc")}
    assert {(r["kind"], r["target"]) for r in rows("a.rs", src, what="ffi")} == {("export", "main"), ("import", "puts")}


def test_extract_others():
    ts = "import { a, b as c } from './x';\n/** Doc. */\nexport class K extends L implements I { run(q: Q) { this.go(); new Foo(); helper(1); } }\nexport const f = (x) => g(x);\nconst V = 3;\n"
    s = {(r["fqdn"], r["kind"]) for r in rows("src/t.ts", ts)}
    assert {("m::K", "type"), ("m::K::run", "callable"), ("m::f", "callable"), ("m::V", "value")} <= s
    e = {(r["kind"], r["target"]) for r in rows("src/t.ts", ts, what="edge")}
    assert {("EXTENDS", "L"), ("IMPLEMENTS", "I"), ("CALLS", "helper"), ("CALLS", "this.go"), ("IMPORTS", "x::a"), ("USES_TYPE", "Q"), ("CALLS", "g")} <= e
    lu = "local M = {}\nlocal q = require('a.b')\n--- Trims.\nfunction M.trim(s) return string.gsub(s) end\nlocal function hid() end\nreturn M\n"
    assert {("m::M::trim", "public"), ("m::hid", "private")} <= {(r["fqdn"], r["visibility"]) for r in rows("l.lua", lu)}
    assert ("IMPORTS", "a::b") in {(r["kind"], r["target"]) for r in rows("l.lua", lu, what="edge")}
    cc = "#include <stdio.h>\n#include \"x.h\"\n#define N 3\ntypedef struct s { int a; } s_t;\nenum { A, B = 2 };\nstatic int f(int a) { g(a); return 0; }\nint h(void);\n"
    assert {("m::N", "macro_object"), ("m::s", "struct"), ("m::A", "enum_variant"), ("m::f", "fn"), ("m::h", "fn_decl")} <= {(r["fqdn"], r["language_kind"]) for r in rows("c.c", cc)}
    vue = "<template><Foo :x=\"bar\" @click=\"go\">{{ name }}</Foo></template>\n<script setup lang=\"ts\">\nfunction go(): void { run(); }\n</script>\n"
    assert {"Foo", "bar", "go", "name"} <= {r["target"] for r in rows("v.vue", vue, what="edge") if r["kind"] == "REFERENCES"}
    assert [r["start_line"] for r in rows("v.vue", vue) if r["name"] == "go"] == [3]
    assert rows("x.rs", "fn f() { \"open") and extract.extract_text("a.py", "x", "m") == []


def test_extract_frames(spark):
    f = spark.createDataFrame([("src/lib.rs", "fn a() { b() }", "my-crate"), ("x.rs", None, "p"), (None, "fn z() {}", "p"), ("e.rs", "", None)], "path string, content string, project string")
    out = extract.extract(f, extract.return_types(f))
    assert {(r.fqdn, r.kind) for r in out.where("what = 'symbol'").collect()} == {("my_crate", "module"), ("my_crate::a", "callable"), ("e", "module")}
    assert extract.extract(f.limit(0)).count() == 0


def test_return_types_of_any_number(spark):
    """More single-typed names than were once collected: all come out, and each file gets those it calls."""
    many = spark.range(200_100).select(F.format_string("f%d.rs", "id").alias("path"), F.format_string("fn f%d() -> a::T%d { }", "id", "id").alias("content"))
    returns = extract.return_types(many)
    assert returns.count() == 200_100
    f = spark.createDataFrame([("u.rs", "fn g() { let x = f7(); x.go(); let y = f200099 (); y.stop(); let z = h(); z.no(); }", "p"), ("v.rs", "fn k() { f7(); }", "p")], "path string, content string, project string")
    e = {(r.target, r.receiver_type) for r in extract.extract(f, returns).where("kind = 'CALLS'").collect()}
    assert {("go", "T7"), ("stop", "T200099"), ("no", None)} <= e


def test_extract_variants_re_exports_elements():
    src = "pub enum E<T> {\n    /// None.\n    A,\n    #[x(Y)]\n    B(Foo, Option<T>, m::Bar) ,\n    C { q: Baz::Q } = 3,\n}\n"
    s = {(r["fqdn"], r["kind"], r["visibility"], r["start_line"]) for r in rows("a.rs", src) if r["language_kind"] == "enum_variant"}
    assert s == {("m::E::A", "type", "public", 3), ("m::E::B", "type", "public", 5), ("m::E::C", "type", "public", 6)}
    assert {(r["fqdn"], r["target"]) for r in rows("a.rs", src, what="edge") if r["kind"] == "USES_TYPE"} == {("m::E::B", "Foo"), ("m::E::B", "Option"), ("m::E::B", "Bar"), ("m::E::C", "Baz::Q")}
    assert ("m::E::A", "None.") in {(r["fqdn"], r["target"]) for r in rows("a.rs", src, what="doc")}
    ts = "export * from './a';\nexport * as ns from './n';\nexport { x, y as z, default as d, type T } from '../b';\nexport type { U } from 'pkg';\nexport {} from './e'\nexport { own };\nexport const k = 1;\n"
    e = {(r["target"], r["attribute"]) for r in rows("src/p/t.ts", ts, what="edge") if r["kind"] == "IMPORTS"}
    assert e == {("p::a", "re-export,wildcard"), ("p::n", "re-export,namespace"), ("b::x", "re-export"), ("b::y", "re-export"), ("b::default", "re-export"), ("b::T", "re-export"), ("pkg::U", "re-export"), ("p::e", "re-export")}
    assert [r["visibility"] for r in rows("src/p/t.ts", ts) if r["name"] == "k"] == ["public"]
    jsx = "function A(p) { return <Foo a={q.r} {...rest} b=\"> s\" on={(ev) => go(ev)}>{name} text {cond ? <Baz t={u}/> : {v: x}}<div c={y}>{z}</div></Foo>; }\nrender(<App/>);\n"
    e = {(r["fqdn"], r["target"], r["attribute"][9:]) for r in rows("j.jsx", jsx, what="edge") if r["kind"] == "REFERENCES"}
    bind, text = {("m::A", x, "bind") for x in ("q", "rest", "go", "ev", "u", "y")}, {("m::A", x, "interpolation") for x in ("name", "cond", "x", "z")}
    assert e == bind | text | {("m::A", "Foo", "component-ref"), ("m::A", "Baz", "component-ref"), ("m", "App", "component-ref")}


def test_extract_arguments_whole():
    def args(path, text):
        return {r["target"]: [(x["value"], x["is_string_literal"]) for x in r["args"]] for r in rows(path, text, what="call")}

    long = "x" * 500
    src = f"fn f() {{ g(\"{long}\", a::<B, C>(1, 2), |p, q| p + q, x < y, r#\"r\"q\"#, \"t\\n\\u{{41}}\", b\"z\", [1, 2],); none(); log!(\"a, b\", k); h({long}); }}"
    a = args("a.rs", src)
    assert a["g"] == [(long, True), ("a::<B, C>(1, 2)", False), ("|p, q| p + q", False), ("x < y", False), ("r\"q", True), ("t\nA", True), ("b\"z\"", False), ("[1, 2]", False)]
    assert a["none"] == [] and a["log!"] == [("a, b", True), ("k", False)] and a["h"] == [(long, False)]
    assert [r["attribute"] for r in rows("a.rs", src, what="call") if r["target"] == "h"] == [long]
    a = args("a.js", "function f() { g('a\\'b', (x, y) => x, `t ${p(1), q} u`, i < j, k > (l), {m, n}, ...o); }")
    assert a["g"] == [("a'b", True), ("(x, y) => x", False), ("`t ${p(1), q} u`", False), ("i < j", False), ("k > (l)", False), ("{m, n}", False), ("...o", False)]
    assert args("a.lua", "function f() g('a', [[b]], function(x, y) return x, y end, c) end")["g"] == [("a", True), ("b", True), ("function(x, y) return x, y end", False), ("c", False)]
    assert args("a.ts", "function f() { g(new Map<K, V>(z), i < j); }")["g"] == [("new Map<K, V>(z)", False), ("i < j", False)]
