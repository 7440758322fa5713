"""Traversal, positions, neighbours, resolution on the small cases the operators were designed for."""

from pyspark.sql import functions as F

from lodestone.operators import graph, lookup, neighbors, position, resolve, rollup

E = "workspace_id string, edge_id bigint, from_fqdn string, kind string, to_unresolved string, resolved boolean, target string, receiver_type string"
S = "workspace_id string, fqdn string, name string, kind string, file_path string, start_line int, end_line int, start_col int, end_col int, flags array<string>, module string, visibility string, entry_point string"


def syms(spark, *rows):
    return spark.createDataFrame([({"workspace_id": "primary", "name": r["fqdn"].rsplit("::", 1)[-1], "kind": "callable", "flags": []} | r) for r in rows], S)


def edges(spark, *rows):
    return spark.createDataFrame([("primary", i, a, k, None, True, b, None) for i, (a, k, b) in enumerate(rows)], E)


def walk(spark, es, focal, n=None, **kw):
    s = syms(spark, *[{"fqdn": x} for x in sorted({y for a, _, b in es for y in (a, b)})])
    f = spark.createDataFrame([(focal,)], "focal string")
    out = graph.neighbourhood(f, edges(spark, *es), s, **kw).orderBy("ordinal").collect()
    return [(r.node, r.depth) for r in out]


def test_breadth_first_order_cap_and_kinds(spark):
    es = [("a", "CALLS", "b"), ("a", "IMPORTS", "c"), ("d", "CALLS", "a"), ("b", "CALLS", "e"), ("e", "CALLS", "f")]
    assert walk(spark, es, "a", depth=1) == [("a", 0), ("b", 1), ("c", 1), ("d", 1)]
    assert walk(spark, es, "a", depth=2)[-1] == ("e", 2)
    assert walk(spark, es, "a", depth=5, max_nodes=3) == [("a", 0), ("b", 1), ("c", 1)]
    assert walk(spark, es, "a", depth=2, kinds=["CALLS"]) == [("a", 0), ("b", 1), ("d", 1), ("e", 2)]
    assert walk(spark, es, "nobody") == []
    assert walk(spark, [("a", "CALLS", "a")], "a") == [("a", 0)]


def test_shipped_edges_have_both_ends(spark):
    es = [("a", "CALLS", "b"), ("a", "CALLS", "b"), ("b", "CALLS", "a"), ("b", "CALLS", "c")]
    s = syms(spark, *[{"fqdn": x} for x in "abc"])
    nodes = graph.neighbourhood(spark.createDataFrame([("a",)], "focal string"), edges(spark, *es), s, depth=1)
    got = {(r.from_fqdn, r.to_fqdn, r.outbound) for r in graph.edges_within(nodes, edges(spark, *es), depth=1).collect()}
    assert got == {("a", "b", True), ("b", "a", False)}
    n, e = graph.bounded(s, edges(spark, *es), n=2)
    assert {r.fqdn for r in n.collect()} == {"a", "b"} and e.count() == 2


def test_smallest_symbol_and_outline(spark):
    s = syms(spark, {"fqdn": "outer", "file_path": "f", "start_line": 1, "end_line": 100, "start_col": 0, "end_col": 1}, {"fqdn": "outer::inner", "file_path": "f", "start_line": 10, "end_line": 20, "start_col": 4, "end_col": 1}, {"fqdn": "nopos", "file_path": "f"})
    p = spark.createDataFrame([(1, "f", 15, 0), (2, "f", 100, 0), (3, "f", 10, 3), (4, "g", 1, 1), (5, None, None, None), (6, "f", 101, 0)], "probe_id int, file_path string, line int, col int")
    assert {r.probe_id: r.fqdn for r in position.symbol_at(p, s).collect()} == {1: "outer::inner", 2: "outer", 3: "outer", 4: None, 5: None, 6: None}
    assert {r.fqdn: r.container for r in position.outline(s).collect()} == {"outer": None, "outer::inner": "outer"}


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("ext/vscode/a.ts",), ("ext/vscodex/a.ts",), ("x.rs",), (None,)], "path string")
    roots = spark.createDataFrame([("", 1), ("ext/vscode", 2)], "rel_path string, project_id int")
    assert {r.path: r.project_id for r in position.longest_prefix(rows, "path", roots, "rel_path").collect()} == {"ext/vscode/a.ts": 2, "ext/vscodex/a.ts": 1, "x.rs": 1, None: None}
    assert position.longest_prefix(rows, "path", roots.where("project_id = 2"), "rel_path").where("project_id is null").count() == 3


def test_textual_callers(spark):
    calls = spark.createDataFrame([(1, "x.widget()", "other::a"), (2, "widget", "other::a"), (3, "crate::widget", "known"), (4, "widget", "crate::widget"), (5, "wid", "z"), (6, None, "z"), (7, "my_widget_2", "other::b")], "id int, callee_text string, from_fqdn string")
    req = spark.createDataFrame([("crate::widget", "widget"), ("crate::empty", " ")], "fqdn string, name string")
    known = spark.createDataFrame([("crate::widget", "known")], "fqdn string, from_fqdn string")
    assert {(r.from_fqdn, r.id) for r in neighbors.textual_callers(req, calls, known).collect()} == {("other::a", 1), ("other::b", 7)}
    assert neighbors.textual_callers(req, calls, known, cap=1).count() == 1


def open_edge(spark, receiver, method, kind="CALLS"):
    return spark.createDataFrame([("primary", 1, "x", kind, method, False, method, receiver)], E)


def hit(df):
    r = df.collect()
    return r[0].hit if r else None


def test_receiver_resolution(spark):
    def run(names, receiver, method):
        return hit(resolve.by_receiver(resolve.open_calls(open_edge(spark, receiver, method)), syms(spark, *[{"fqdn": n} for n in names])))

    assert run(["crate::Foo::run"], "crate::Foo", "run") == "crate::Foo::run"
    assert run(["crate::collections::Vec::push"], "Vec", "push") == "crate::collections::Vec::push"
    assert run(["a::Vec::push", "b::Vec::push"], "Vec", "push") is None
    assert run(["a::Vec::push", "b::Vec::push", "<builtin>::rust::Vec::push"], "Vec", "push") == "<builtin>::rust::Vec::push"
    assert run(["a::Vec::push", "<builtin>::rust::Vec::push"], "Vec", "push") == "a::Vec::push"
    assert run(["x::a::Vec::push"], "a::Vec", "push") is None and run(["a::vec::push"], "Vec", "push") is None


def test_trait_and_builtin_routes(spark):
    e = open_edge(spark, "Foo", "go").unionByName(spark.createDataFrame([("primary", i, f, "IMPLEMENTS", None, True, t, None) for i, (f, t) in enumerate([("crate::Foo", "crate::B"), ("crate::Foo", "crate::A"), ("<builtin>::rust::Foo", "crate::AA")], 10)], E))
    s = syms(spark, {"fqdn": "crate::A::go"}, {"fqdn": "crate::B::go"}, {"fqdn": "crate::AA::go"}, {"fqdn": "<builtin>::rust::Iterator::go", "flags": ["trait_method"]}, {"fqdn": "<builtin>::rust::Z::go"})
    assert hit(resolve.by_trait(resolve.open_calls(e), s, e)) == "crate::A::go"
    assert hit(resolve.by_builtin_trait(resolve.open_calls(e), s)) == "<builtin>::rust::Iterator::go"
    assert {r.route: r.edges for r in resolve.report(s, e).collect()} == {"trait_dispatch": 1}


def test_suffix_chain(spark):
    s = syms(spark, {"fqdn": "peer::lib::Foo", "module": "peer::lib", "workspace_id": "p1"}, {"fqdn": "my-crate::m::Bar", "module": "my-crate::m"})
    offers = resolve.exports(s)
    o = resolve.open_calls(open_edge(spark, None, "peer::lib::Foo::new", "CALLS"))
    assert hit(resolve.by_suffix_chain(o, offers)) == "peer::lib::Foo::new"
    assert hit(resolve.by_suffix_chain(resolve.open_calls(open_edge(spark, None, "my_crate::m::Bar")), offers)) == "my-crate::m::Bar"
    assert hit(resolve.by_suffix_chain(resolve.open_calls(open_edge(spark, None, "no::such::Thing")), offers)) is None


def test_declarations_and_foreign_links(spark):
    s = syms(spark, {"fqdn": "h::lur", "name": "lur", "file_path": "include/vm.h"}, {"fqdn": "c::lur", "name": "lur", "file_path": "runtime/vm.c"}, {"fqdn": "h::x", "name": "x", "file_path": "a.h"}, {"fqdn": "h::y", "name": "y", "file_path": "a.h"}, {"fqdn": "c::y", "name": "y", "file_path": "a.c"}, {"fqdn": "d::y", "name": "y", "file_path": "b.c"}, {"fqdn": "q::x", "name": "x", "file_path": "q.c", "workspace_id": "other"})
    assert {r.decl_fqdn: (r.def_fqdn, r.outcome) for r in resolve.declaration_twins(s).collect()} == {"h::lur": ("c::lur", "joined"), "h::x": (None, "orphan"), "h::y": (None, "ambiguous")}
    b = [("primary", f, "c", d, n) for f, d, n in [("e", "export", "p"), ("i1", "import", "p"), ("i2", "import", "p"), ("e1", "export", "q"), ("e2", "export", "q"), ("i3", "import", "q"), ("s", "export", "z"), ("s", "import", "z"), ("o", "import", "none")]]
    bind = spark.createDataFrame(b, "workspace_id string, fqdn string, abi string, direction string, abi_name string")
    none = spark.createDataFrame([], "workspace_id string, from_fqdn string, kind string, to_fqdn string")
    got = resolve.foreign_links(bind, none)
    assert {(r.from_fqdn, r.to_fqdn, r.attribute) for r in got.collect()} == {("i1", "e", "ffi:c"), ("i2", "e", "ffi:c")}
    assert resolve.foreign_links(bind, got.withColumn("kind", F.lit("IMPORTS"))).count() == 0


def test_scope_chain_and_builtin_tiers(spark):
    scopes = spark.createDataFrame([("m", 0, None), ("m", 1, 0), ("m", 2, 1)], "module string, scope_idx int, parent_idx int")
    b = spark.createDataFrame([("m", 0, 0, "x", "root"), ("m", 2, 0, "x", "old"), ("m", 2, 1, "x", "new"), ("m", 1, 0, "y", "mid")], "module string, scope_idx int, ordinal int, name string, target string")
    u = spark.createDataFrame([(1, "m", 2, "x"), (2, "m", 1, "x"), (3, "m", 2, "y"), (4, "m", 2, "z")], "use_id int, module string, scope_idx int, name string")
    assert {r.use_id: r.target for r in resolve.local_names(u, scopes, b).collect()} == {1: "new", 2: "root", 3: "mid"}
    t = spark.createDataFrame([("rust", "Clone", "attribute", None), ("rust", "vec", "edge", "<builtin>::rust::vec"), ("rust", "dbg", "drop", None)], "language string, name string, tier string, synthetic_fqdn string")
    e = spark.createDataFrame([(1, "rust", "Clone"), (2, "rust", "vec"), (3, "rust", "dbg"), (4, "c", "vec"), (5, None, None)], "edge_id int, language string, name string")
    assert {r.edge_id: (r.tier, r.to_fqdn, r.flag) for r in resolve.builtin_tier(e, t).collect()} == {1: ("attribute", None, "builtin-clone"), 2: ("edge", "<builtin>::rust::vec", None), 3: ("drop", None, None), 4: ("none", None, None), 5: ("none", None, None)}


def test_pages_walk_the_full_set_and_calls_are_capped(spark):
    s = syms(spark, *[{"fqdn": f"n{i:03d}"} for i in range(25)])
    seen, cursor = [], None
    while True:
        rows = lookup.page(s, lookup.symbol_filter(), cursor, 10).orderBy("fqdn").collect()
        seen += [r.fqdn for r in rows]
        cursor = rows[0].next_cursor if rows else None
        if cursor is None:
            break
    assert seen == [f"n{i:03d}" for i in range(25)]
    c = spark.createDataFrame([(i, "a" if i % 2 else "b", "x.run") for i in range(300)], "id int, from_fqdn string, callee_text string")
    assert lookup.call_sites(c).count() == 50 and lookup.call_sites(c, limit=900).count() == 200 and lookup.call_sites(c, limit=0).count() == 0
    assert {r.id for r in lookup.call_sites(c, from_fqdn="a", pattern="*.r?n", limit=3).collect()} == {1, 3, 5}


def test_search_phrases_and_fallback(spark):
    d = spark.createDataFrame([("a::load_db", "load_db"), ("b::db_load", "db_load"), ("c::other", "other"), (None, None)], "fqdn string, name string")
    q = spark.createDataFrame([(1, "load_db"), (2, "load db"), (3, "load nosuch"), (4, "")], "request_id int, query string")
    got = {}
    for r in lookup.search(d, ["fqdn"], F.concat_ws(" ", "name", "fqdn"), q).collect():
        got.setdefault(r.request_id, set()).add(r.fqdn)
    assert got == {1: {"a::load_db"}, 2: {"a::load_db", "b::db_load"}, 3: {"a::load_db", "b::db_load"}}


def test_rollups(spark):
    p = spark.createDataFrame([(1, "x", "a"), (2, "x", "b"), (3, "y", "c")], "project_id int, label string, rel_path string")
    assert {r.project_id: r.canonical_id for r in rollup.canonical_projects(p).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.project_id: r.shown for r in rollup.labels(p).collect()} == {1: "x (a)", 2: "x (b)", 3: "y"}
    r = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/d"), (2, "q"), (3, "a/x"), (3, "b/x"), (4, None)], "g int, p string")
    assert {x.g: x.prefix for x in rollup.common_path(r, "g", "p").collect()} == {1: "a/b", 2: "q", 3: ""}
    s = syms(spark, {"fqdn": "m::long::z", "module": "m"}, {"fqdn": "m::b", "module": "m", "visibility": "public"}, {"fqdn": "m::a::main", "module": "m", "entry_point": "binary_main"}, {"fqdn": "n::q", "module": "n"})
    assert {x.module: x.representative for x in rollup.representative(s).collect()} == {"m": "m::a::main", "n": "n::q"}


def test_empty_tables(spark):
    s, e = spark.createDataFrame([], S), spark.createDataFrame([], E)
    assert neighbors.summary(s, e).count() == 0 and resolve.sweep(s, e).count() == 0 and position.outline(s).count() == 0
    assert graph.neighbourhood(spark.createDataFrame([], "focal string"), e, s).count() == 0


def test_scoped_edges(spark):
    s = syms(spark, *({"fqdn": x, "kind": "module"} for x in ("p", "p::a", "p::b", "p::a::c", "p::a::d")), *({"fqdn": x} for x in ("p::a::f", "p::b::g", "p::a::c::h", "p::a::d::i", "p::k")))
    e = spark.createDataFrame([("primary", n, a, "CALLS", None, t is not None, t, None) for n, (a, t) in enumerate((("p::a::f", "p::b::g"), ("p::a::c::h", "p::b::g"), ("p::a::c::h", "p::a::d::i"), ("p::k", "p::b::g"), ("p::a::f", "p::a::f"), ("p::b::g", None)))], E)
    r = {tuple(x) for x in rollup.scoped_edges(s, e).collect()}
    assert {x for x in r if x[3] == "cross"} == {("p", "p::a", "p::b", "cross", "CALLS", 2), ("p::a", "p::a::c", "p::a::d", "cross", "CALLS", 1)}
    assert {x[:3] for x in r if x[3] == "parent_child"} == {("p", "p", "p::a"), ("p", "p", "p::b"), ("p::a", "p::a", "p::a::c"), ("p::a", "p::a", "p::a::d")}
    deep = syms(spark, {"fqdn": "q::x::m", "kind": "module"}, {"fqdn": "q::y::n", "kind": "module"})
    cross = spark.createDataFrame([("primary", 1, "q::x::m", "CALLS", None, True, "q::y::n", None)], E)
    assert ("q", "q::x", "q::y", "cross", "CALLS", 1) in {tuple(x) for x in rollup.scoped_edges(deep, cross).collect()}
