"""Driver queries on small literal tables: rules for which the test data holds no case (operators O-12, O-39 to O-41, O-48, O-68,
O-105, O-106, O-109, O-117, O-125, O-133, O-134, O-147, O-148)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import builtins, extract, imports, incremental, neighbors, resolve, storage
from lodestone.plans.cases import Cases
from lodestone.plans.registry import Registry
from lodestone.sources import workspace
from lodestone.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.QUERIES, _R.SQL, _R.query

W, V = "primary", "peer"

#: A small graph: receivers by exact path, by unique and by ambiguous suffix, a built-in, traits, tests.
SYMBOLS = Cases("s", "workspace_id string, fqdn string, name string, flags array<string>", [
    (W, "app::Foo::run", "run", None), (W, "app::store::Queue::push", "push", None), (W, "app::a::Pair::get", "get", None), (W, "app::b::Pair::get", "get", None), (W, "app::Walk::step", "step", None), (W, "app::Zeal::step", "step", None),
    (W, "<builtin>::rust::Vec::push", "push", []), (W, "<builtin>::rust::Clone::clone", "clone", ["trait_method"]), (W, "<builtin>::rust::Zip::clone", "clone", ["trait_method"]), (W, "app::Tree", "Tree", None), (V, "other::thing", "thing", None),
])
EDGES = Cases("e", "edge_id bigint, workspace_id string, from_fqdn string, kind string, to_unresolved string, receiver_type string, resolved boolean, target string", [
    (1, W, "app::main", "CALLS", "run", "app::Foo", False, "run"), (2, W, "app::main", "CALLS", "push", "Queue", False, "push"), (3, W, "app::main", "CALLS", "get", "Pair", False, "get"), (4, W, "app::main", "CALLS", "push", "Vec", False, "push"), (5, W, "app::main", "CALLS", "step", "Tree", False, "step"),
    (6, W, "app::main", "CALLS", "clone", None, False, "clone"), (7, W, "app::main", "CALLS", "run", None, False, "run"), (8, W, "app::main", "IMPORTS", "run", "app::Foo", False, "run"), (9, W, "app::main", "CALLS", "push", "a::Queue", False, "push"),
    (20, W, "app::Tree", "IMPLEMENTS", None, None, True, "app::Zeal"), (21, W, "app::Tree", "IMPLEMENTS", None, None, True, "app::Walk"), (22, W, "<builtin>::rust::Pair", "IMPLEMENTS", None, None, True, "app::Walk"),
    (30, W, "app::tests::works", "CALLS", None, None, True, "app::Foo::run"), (31, W, "app::run_test", "USES_TYPE", None, None, True, "app::Tree"), (32, W, "app::use_it", "CALLS", None, None, True, "app::Foo::run"), (33, W, "app::tests::works", "CALLS", None, None, True, "app::Tree"),
])
_OPEN = f"{SYMBOLS.sql}, {EDGES.sql}, o AS (SELECT * FROM e WHERE NOT resolved AND to_unresolved IS NOT NULL AND kind = 'CALLS')"


@query(f"""WITH {_OPEN}, t AS (SELECT array_to_string(string_split(fqdn, '::')[-2:], '::') AS key, min(fqdn) AS tail FROM s WHERE NOT starts_with(fqdn, '<builtin>') AND len(string_split(fqdn, '::')) >= 3 GROUP BY 1 HAVING count(*) = 1)
SELECT o.edge_id, coalesce(x.fqdn, CASE WHEN NOT contains(receiver_type, '::') THEN t.tail END, b.fqdn) AS hit, CASE WHEN x.fqdn IS NOT NULL THEN 'receiver_exact' WHEN NOT contains(receiver_type, '::') AND t.tail IS NOT NULL THEN 'receiver_suffix' ELSE 'receiver_builtin' END AS route
FROM o LEFT JOIN s x ON x.fqdn = receiver_type || '::' || to_unresolved LEFT JOIN t ON t.key = receiver_type || '::' || to_unresolved LEFT JOIN s b ON b.fqdn = '<builtin>::rust::' || receiver_type || '::' || to_unresolved
WHERE receiver_type IS NOT NULL AND coalesce(x.fqdn, CASE WHEN NOT contains(receiver_type, '::') THEN t.tail END, b.fqdn) IS NOT NULL""")
def o40_receiver_cases(spark: SparkSession, root: str) -> DataFrame:
    """Exact, unique suffix, ambiguous (none), built-in; other kinds and qualified names don't take the suffix."""
    return resolve.by_receiver(resolve.open_calls(EDGES.frame(spark)), SYMBOLS.frame(spark))


@query(f"WITH {_OPEN}, i AS (SELECT from_fqdn AS r, target FROM e WHERE kind = 'IMPLEMENTS' AND NOT starts_with(from_fqdn, '<builtin>') UNION SELECT string_split(from_fqdn, '::')[-1], target FROM e WHERE kind = 'IMPLEMENTS' AND NOT starts_with(from_fqdn, '<builtin>')) SELECT o.edge_id, min_by(s.fqdn, i.target) AS hit, 'trait_dispatch' AS route FROM o JOIN i ON i.r = o.receiver_type JOIN s ON s.fqdn = i.target || '::' || o.to_unresolved GROUP BY o.edge_id")
def o41_trait_cases(spark: SparkSession, root: str) -> DataFrame:
    """The alphabetically first trait that has the method."""
    e = EDGES.frame(spark)
    return resolve.by_trait(resolve.open_calls(e), SYMBOLS.frame(spark), e)


@query(f"WITH {_OPEN} SELECT o.edge_id, min(s.fqdn) AS hit, 'builtin_trait' AS route FROM o JOIN s ON s.name = o.to_unresolved AND starts_with(s.fqdn, '<builtin>') AND list_contains(s.flags, 'trait_method') GROUP BY o.edge_id")
def o42_builtin_trait_cases(spark: SparkSession, root: str) -> DataFrame:
    return resolve.by_builtin_trait(resolve.open_calls(EDGES.frame(spark)), SYMBOLS.frame(spark))


@query(f"WITH {SYMBOLS.sql}, {EDGES.sql} SELECT target AS fqdn, from_fqdn AS neighbour, edge_id FROM e WHERE target IN (SELECT fqdn FROM s) AND (contains(from_fqdn, '::tests::') OR suffix(from_fqdn, '_test') OR suffix(from_fqdn, '_tests')) AND kind <> 'IMPORTS'")
def o68_test_cases(spark: SparkSession, root: str) -> DataFrame:
    """Tests of a symbol: its callers and dependents that are tests, as often as they point at it."""
    return neighbors.grouped(SYMBOLS.frame(spark), EDGES.frame(spark)).where("bucket = 'tests'").select("fqdn", "neighbour", "edge_id")


PATHS = Cases("p", "path string", [("src/a.rs",), ("src/b.rs",), (None,)])
STORED = Cases("k", "fqdn string, file_path string, is_external boolean", [("a::x", "src/a.rs", None), ("c::y", "src/gone.rs", None), ("c::z", "src/gone.rs", False), ("e::w", "vendor/gone.rs", True), ("n::n", None, None)])


@query(f"WITH {PATHS.sql}, {STORED.sql} SELECT fqdn, file_path FROM k WHERE NOT coalesce(is_external, false) AND file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.path = k.file_path)")
def o48_unseen_cases(spark: SparkSession, root: str) -> DataFrame:
    """Symbols of vanished files; external ones are exempt."""
    s = STORED.frame(spark).where("not coalesce(is_external, false) and file_path is not null").select("fqdn", "file_path")
    return incremental.delete_by(s, PATHS.frame(spark).select(F.col("path").alias("file_path")), ["file_path"])


BINDINGS = Cases("b", "workspace_id string, fqdn string, abi string, direction string, abi_name string", [
    (W, "rs::init", "c", "import", "vm_init"), (W, "lua::init", "c", "import", "vm_init"), (W, "c::vm_init", "c", "export", "vm_init"), (W, "rs::two", "c", "import", "vm_two"), (W, "c::two", "c", "export", "vm_two"), (W, "d::two", "c", "export", "vm_two"),
    (W, "rs::alone", "c", "import", "vm_alone"), (W, "c::self", "c", "import", "vm_self"), (W, "c::self", "c", "export", "vm_self"), (V, "rs::far", "c", "import", "vm_init"), (W, "rs::lua", "lua", "import", "vm_init"), (W, "rs::none", None, "import", "vm_init"), (W, "rs::old", "c", "import", "vm_old"), (W, "c::old", "c", "export", "vm_old"),
])
LINKED = Cases("l", "workspace_id string, from_fqdn string, kind string, to_fqdn string", [(W, "rs::old", "IMPORTS", "c::old"), (W, "rs::init", "CALLS", "c::vm_init")])


@query(f"""WITH {BINDINGS.sql}, {LINKED.sql}, x AS (SELECT workspace_id, abi, abi_name, min(fqdn) AS to_fqdn FROM b WHERE direction = 'export' AND abi IS NOT NULL GROUP BY ALL HAVING count(DISTINCT fqdn) = 1)
SELECT DISTINCT b.workspace_id, b.fqdn AS from_fqdn, x.to_fqdn, 'ffi:' || b.abi AS attribute FROM b JOIN x USING (workspace_id, abi, abi_name) WHERE b.direction = 'import' AND b.fqdn <> x.to_fqdn AND NOT EXISTS (SELECT 1 FROM l WHERE l.kind = 'IMPORTS' AND l.workspace_id = b.workspace_id AND l.from_fqdn = b.fqdn AND l.to_fqdn = x.to_fqdn)""")
def o39_foreign_cases(spark: SparkSession, root: str) -> DataFrame:
    """One exporter links every importer; two, none, oneself, another abi or workspace and known links give nothing."""
    return resolve.foreign_links(BINDINGS.frame(spark), LINKED.frame(spark))


@query(f"WITH {BINDINGS.sql} SELECT direction, count(*) AS bindings, count(DISTINCT abi_name) AS names FROM b WHERE fqdn NOT IN ('c::two', 'd::two') GROUP BY direction")
def o134_binding_sides(spark: SparkSession, root: str) -> DataFrame:
    """All bindings of either side after those of two symbols were deleted and all were written twice."""
    b = BINDINGS.frame(spark)
    left = incremental.delete_by(incremental.upsert(b.limit(0), b.unionByName(b), b.columns), b.where("fqdn in ('c::two', 'd::two')").select("fqdn"), ["fqdn"])
    return left.groupBy("direction").agg(F.count("*").alias("bindings"), F.countDistinct("abi_name").alias("names"))


TWINS = Cases("d", "workspace_id string, fqdn string, name string, kind string, file_path string", [
    (W, "vm_h::vm_new", "vm_new", "callable", "include/vm.h"), (W, "vm_c::vm_new", "vm_new", "callable", "runtime/vm.c"), (W, "vm_h::vm_two", "vm_two", "callable", "include/vm.h"), (W, "a_c::vm_two", "vm_two", "callable", "runtime/a.c"), (W, "b_c::vm_two", "vm_two", "callable", "runtime/b.c"),
    (W, "vm_h::vm_orphan", "vm_orphan", "callable", "include/vm.h"), (V, "vm_c::vm_orphan", "vm_orphan", "callable", "runtime/vm.c"), (W, "vm_h::VM", "VM", "type", "include/vm.h"),
])


@query(f"WITH {TWINS.sql}, f AS (SELECT workspace_id, name, count(*) AS n, min(fqdn) AS def_fqdn FROM d WHERE kind = 'callable' AND suffix(file_path, '.c') GROUP BY ALL) SELECT d.workspace_id, d.fqdn AS decl_fqdn, CASE WHEN n = 1 THEN def_fqdn END AS def_fqdn, CASE WHEN n = 1 THEN 'joined' WHEN n > 1 THEN 'ambiguous' ELSE 'orphan' END AS outcome FROM d LEFT JOIN f USING (workspace_id, name) WHERE d.kind = 'callable' AND suffix(d.file_path, '.h')")
def o133_declaration_cases(spark: SparkSession, root: str) -> DataFrame:
    """Joined, ambiguous and orphan declarations; another workspace's definition doesn't count."""
    return resolve.declaration_twins(TWINS.frame(spark))


SCOPES = Cases("sc", "module string, scope_idx int, parent_idx int", [("m", 0, None), ("m", 1, 0), ("m", 2, 1), ("n", 0, None)])
NAMES = Cases("bn", "module string, scope_idx int, ordinal int, name string, target string", [("m", 0, 0, "a", "root::a"), ("m", 1, 1, "a", "mid::a"), ("m", 1, 2, "a", "mid::a2"), ("m", 2, 3, "b", "leaf::b"), ("m", 0, 4, "c", "root::c"), ("n", 0, 0, "a", "n::a")])
USES = Cases("u", "use_id int, module string, scope_idx int, name string", [(1, "m", 2, "a"), (2, "m", 2, "b"), (3, "m", 1, "b"), (4, "m", 2, "c"), (5, "n", 0, "a"), (6, "n", 0, "c"), (7, "m", 0, "a")])


@query(f"WITH RECURSIVE {SCOPES.sql}, {NAMES.sql}, {USES.sql}, c AS (SELECT use_id, module, name, scope_idx AS cur, 0 AS up FROM u UNION ALL SELECT c.use_id, c.module, c.name, sc.parent_idx, c.up + 1 FROM c JOIN sc ON sc.module = c.module AND sc.scope_idx = c.cur WHERE sc.parent_idx IS NOT NULL) SELECT use_id, target FROM c JOIN bn ON bn.module = c.module AND bn.scope_idx = c.cur AND bn.name = c.name QUALIFY row_number() OVER (PARTITION BY use_id ORDER BY up, ordinal DESC) = 1")
def o148_scope_cases(spark: SparkSession, root: str) -> DataFrame:
    """The innermost scope wins, in it the latest binding."""
    return resolve.local_names(USES.frame(spark), SCOPES.frame(spark), NAMES.frame(spark))


BRIDGES = Cases("br", "source string, target string, ordinal int, name string, mapped string", [("node", "wasi", 1, "fs.readFileSync", "path_open"), ("node", "wasi", 0, "fs.readFileSync", "fd_read"), ("node", "deno", 0, "fs.readFileSync", "Deno.readFileSync")])
ASKED = Cases("q", "source string, target string, name string", [("node", "wasi", "fs.readFileSync"), ("node", "deno", "fs.readFileSync"), ("node", "deno", "fs.stat"), ("bun", "deno", "fs.readFileSync")])


@query(f"WITH {BRIDGES.sql}, {ASKED.sql} SELECT q.source, q.target, q.name, min_by(br.mapped, br.ordinal) AS mapped FROM q LEFT JOIN br USING (source, target, name) GROUP BY ALL")
def o147_bridge_cases(spark: SparkSession, root: str) -> DataFrame:
    return builtins.bridged(ASKED.frame(spark), BRIDGES.frame(spark))


EXTERNALS = Cases("x", "provider string, available boolean, fqdn string, file_path string", [("cargo", True, "serde::Value", "serde/value.rs"), ("cargo", True, None, None), ("npm", False, None, None)])
WANTED = Cases("w", "provider string, fqdn string", [("cargo", "serde::Value"), ("cargo", "serde::Nope"), ("npm", "react::use"), ("luarocks", "lpeg")])


@query(f"WITH {EXTERNALS.sql}, {WANTED.sql}, h AS (SELECT provider, max(available) AS available FROM x GROUP BY provider) SELECT w.provider, w.fqdn, x.file_path, CASE WHEN x.file_path IS NOT NULL THEN 'resolved' WHEN NOT coalesce(h.available, false) THEN 'missing_binary' ELSE 'not_found' END AS status FROM w LEFT JOIN h USING (provider) LEFT JOIN x ON x.provider = w.provider AND x.fqdn = w.fqdn")
def o12_external_cases(spark: SparkSession, root: str) -> DataFrame:
    return workspace.external_lookup(WANTED.frame(spark), EXTERNALS.frame(spark))


TREE = Cases("f", "path string, project_id int", [("crates/a/src/lib.rs", 1), ("crates/a/web/x.ts", 1), ("tools/t.lua", None), ("README.c", None)])
FOUND = Cases("n", "rel_path string, kind string, label string", [("crates/a", "rust", "a"), ("crates/a/web", "node", "web")])
BEFORE = Cases("o", "project_id int, label string, kind string, root_path string, rel_path string", [(1, "a", "rust", "crates/a", "crates/a"), (2, "gone", "lua", "tools", "tools")])
TOUCHED = Cases("c", "path string", [("crates/a/web/package.json",), ("README.c",)])


@query(f"""WITH {TREE.sql}, {FOUND.sql}, {BEFORE.sql}, ids AS (SELECT n.rel_path, coalesce(o.project_id, (SELECT max(project_id) FROM o) + row_number() OVER (PARTITION BY o.project_id IS NULL ORDER BY n.rel_path)) AS project_id FROM n LEFT JOIN o USING (rel_path))
SELECT f.path, CAST(max_by(ids.project_id, length(ids.rel_path)) AS INTEGER) AS project_id FROM f LEFT JOIN ids ON starts_with(f.path, ids.rel_path || '/') GROUP BY f.path""")
def o125_manifest_cases(spark: SparkSession, root: str) -> DataFrame:
    """A touched manifest: projects are discovered anew, known ones keep their id, files go to the deepest one above them."""
    return storage.rediscover(BEFORE.frame(spark), FOUND.frame(spark), TREE.frame(spark), TOUCHED.frame(spark), list(workspace.MANIFESTS))[1]


RUST = Cases("r", "path string, content string, project string", [
    ("src/main.rs", "use crate::store::{Queue, self as st};\nuse std::fmt::Debug as D;\npub use super::x::*;\n\nfn main() {}\n", "app"),
    ("src/store.rs", "#[derive(Clone, Copy, Serialize)]\npub struct Queue;\n\nimpl Walk for Queue {}\n\n#[no_mangle]\npub extern \"C\" fn vm_go() {}\n\nfn main() {}\n", "app"),
    ("src/deep/mod.rs", "#[derive(Debug, Eq)]\nenum Kind { A }\n\nimpl<T> Iterator for Wrap<T> {}\n", "app"),
])
_DERIVES = ", ".join(f"'{d}'" for d in extract.DERIVES)


@query(rf"""WITH {RUST.sql}, d AS (SELECT path, unnest(regexp_extract_all(content, '#\[derive\(([^)]*)\)\]\n(?:pub )?(?:struct|enum) (\w+)')) AS m FROM r),
x AS (SELECT path, regexp_extract(m, '(?:struct|enum) (\w+)', 1) AS owner, trim(unnest(string_split(regexp_extract(m, 'derive\(([^)]*)\)', 1), ','))) AS t FROM d), i AS (SELECT path, unnest(regexp_extract_all(content, 'impl(?:<\w+>)? \w+ for \w+')) AS m FROM r)
SELECT path, owner, '<builtin>::rust::' || t AS target, 'derive' AS attribute FROM x WHERE t IN ({_DERIVES}) UNION ALL SELECT path, regexp_extract(m, 'for (\w+)', 1), regexp_extract(m, '(\w+) for', 1), NULL FROM i""")
def o105_implements_cases(spark: SparkSession, root: str) -> DataFrame:
    """IMPLEMENTS from impl blocks and derives; derives of traits without methods give none."""
    x = extract.extract(RUST.frame(spark)).where("what = 'edge' and kind = 'IMPLEMENTS'")
    return x.select("path", F.substring_index("fqdn", "::", -1).alias("owner"), "target", "attribute")


@query(rf"WITH {RUST.sql} SELECT path, 'main' AS name, 'binary_main' AS entry_point FROM r WHERE contains(content, 'fn main()') AND path IN ('src/main.rs', 'src/lib.rs') UNION ALL SELECT path, regexp_extract(content, 'no_mangle\]\n.*fn (\w+)', 1), 'ffi_export' FROM r WHERE contains(content, 'no_mangle')")
def o117_entry_cases(spark: SparkSession, root: str) -> DataFrame:
    """``main`` at the crate's root only; exported functions wherever they are."""
    return extract.extract(RUST.frame(spark)).where("what = 'symbol' and entry_point is not null").select("path", "name", "entry_point")


@query("WITH t(target, attribute) AS (VALUES ('app::store::Queue', NULL), ('app::store', 'alias:st'), ('std::fmt::Debug', 'alias:D'), ('x', 'wildcard')) SELECT 'src/main.rs' AS path, target, attribute FROM t")
def o106_use_cases(spark: SparkSession, root: str) -> DataFrame:
    """Paths of ``use`` trees made absolute: crate, self with alias, super, wildcard."""
    return extract.extract(RUST.frame(spark)).where("what = 'edge' and kind = 'IMPORTS'").select("path", "target", "attribute")


@query("""WITH t(module, side, name, origin_module, origin_symbol, resolved_fqdn, re_export) AS (VALUES ('app', 'import', 'Queue', 'app::store', 'Queue', NULL, false), ('app', 'import', 'st', 'app', 'store', NULL, false), ('app', 'import', 'D', 'std::fmt', 'Debug', NULL, false), ('app', 'import', '*', 'x', '*', NULL, true),
('app::store', 'export', 'Queue', NULL, NULL, 'app::store::Queue', false), ('app::store', 'export', 'vm_go', NULL, NULL, 'app::store::vm_go', false)) SELECT * FROM t""")
def o115_lookup_cases(spark: SparkSession, root: str) -> DataFrame:
    """Lookup rows of a crate: names, aliases, a wildcard, public items."""
    return extract.module_lookups(extract.extract(RUST.frame(spark)))


CALLS = Cases("k", "path string, content string, project string", [
    ("src/a.rs", "use crate::store::Queue;\nuse std::mem as m;\nconst MAX: u8 = 1;\nfn go() { Queue::new(); m::swap(a, b); helper(MAX); crate::top(); super::up(); Some(1); println!(1); }\nmod inner {\n    use super::go as g;\n    fn f() { g(); Queue::new(); }\n}\n", "app"),
    ("src/b.ts", "import { load as ld } from './c';\nconst LIMIT = 3;\nfunction run() { ld(LIMIT); console.log(ld); JSON.parse(x); }\ninterface P { a: string; b?(x: number): void }\nenum E { One, Two = 2 }\nclass C { size = 1; go(): void { run(); } }\n", "app"),
])


@query("""WITH t(fqdn, kind, target) AS (VALUES ('app::a::go', 'CALLS', 'app::store::Queue::new'), ('app::a::go', 'CALLS', 'std::mem::swap'), ('app::a::go', 'CALLS', 'app::a::helper'), ('app::a::go', 'CALLS', 'app::top'), ('app::a::go', 'CALLS', 'app::up'), ('app::a::go', 'REFERENCES', 'app::a::MAX'),
('app::a::inner::f', 'CALLS', 'app::a::go'), ('app::a::inner::f', 'CALLS', 'Queue::new'), ('app::b::run', 'CALLS', 'ld'), ('app::b::run', 'CALLS', '<builtin>::typescript::JSON'), ('app::b::run', 'CALLS', 'console.log'), ('app::b::run', 'REFERENCES', 'app::b::LIMIT'), ('app::b::run', 'REFERENCES', 'c::load'), ('app::b::C::go', 'CALLS', 'run')) SELECT * FROM t""")
def o106_scope_cases(spark: SparkSession, root: str) -> DataFrame:
    """Calls and value reads through imports and modules; built-ins dropped or led to their symbol."""
    x = extract.with_builtins(extract.extract(CALLS.frame(spark)), builtins.registry(spark))
    return x.where("what = 'edge' and kind in ('CALLS', 'REFERENCES')").select("fqdn", "kind", "target").distinct()


@query("WITH t(fqdn, kind, language_kind) AS (VALUES ('app::b::P', 'type', 'interface'), ('app::b::P::a', 'value', 'property'), ('app::b::P::b', 'callable', 'method'), ('app::b::E', 'type', 'enum'), ('app::b::E::One', 'value', 'enum_member'), ('app::b::E::Two', 'value', 'enum_member'), ('app::b::C', 'type', 'class'), ('app::b::C::size', 'value', 'property'), ('app::b::C::go', 'callable', 'method'), ('app::b::LIMIT', 'value', 'const'), ('app::b::run', 'callable', 'function'), ('app::b', 'module', 'module')) SELECT * FROM t")
def o108_member_cases(spark: SparkSession, root: str) -> DataFrame:
    """Members of interfaces, enums and classes."""
    x = extract.extract(CALLS.frame(spark))
    return x.where("what = 'symbol' and path = 'src/b.ts'").select("fqdn", "kind", "language_kind").distinct()


SCRIPTS = Cases("f", "path string", [("web/src/a.ts",), ("web/src/util/b.ts",), ("web/src/util/index.ts",), ("web/lib/c.tsx",), ("web/node_modules/react/main.js",), ("node_modules/@x/y/deep.ts",), ("node_modules/react/index.js",)])
SPECS = Cases("i", "file string, spec string", [("web/src/a.ts", "./util/b"), ("web/src/a.ts", "./util"), ("web/src/util/b.ts", "../a"), ("web/src/a.ts", "@lib/c"), ("web/src/a.ts", "react"), ("web/src/a.ts", "@x/y/deep"), ("web/src/a.ts", "./none"), ("web/src/a.ts", "left-pad"), ("web/src/a.ts", "exact")])
CONFIGS = Cases("t", "path string, content string", [("web/tsconfig.json", '{ // aliases\n "compilerOptions": { "baseUrl": ".", "paths": { "@lib/*": ["missing/*", "lib/*"], "exact": ["src/a.ts"], /* no */ } } }')])
PACKAGES = Cases("p", "path string, entry string", [("web/node_modules/react/package.json", "main.js"), ("node_modules/react/package.json", None), ("node_modules/@x/y/package.json", None)])


@query("WITH t(file, spec, resolved, route) AS (VALUES ('web/src/a.ts', './util/b', 'web/src/util/b.ts', 'relative'), ('web/src/a.ts', './util', 'web/src/util/index.ts', 'relative'), ('web/src/util/b.ts', '../a', 'web/src/a.ts', 'relative'), ('web/src/a.ts', '@lib/c', 'web/lib/c.tsx', 'paths'), ('web/src/a.ts', 'react', 'web/node_modules/react/main.js', 'package'), ('web/src/a.ts', '@x/y/deep', 'node_modules/@x/y/deep.ts', 'package'), ('web/src/a.ts', './none', NULL, NULL), ('web/src/a.ts', 'left-pad', NULL, NULL), ('web/src/a.ts', 'exact', 'web/src/a.ts', 'paths')) SELECT * FROM t")
def o109_import_cases(spark: SparkSession, root: str) -> DataFrame:
    """Relative, by tsconfig paths (first target that exists), by the nearest node_modules, and not at all."""
    return imports.resolve_imports(SPECS.frame(spark), SCRIPTS.frame(spark), CONFIGS.frame(spark), PACKAGES.frame(spark))


_SPEC = r"from\s+[''\"]([^''\"]+)[''\"]"


@query(rf"""WITH i AS (SELECT DISTINCT path AS file, unnest(regexp_extract_all(content, '{_SPEC}', 1)) AS spec FROM files WHERE regexp_matches(path, '[.][jt]sx?$') AND content IS NOT NULL), c AS (SELECT file, spec, n, regexp_replace(file, '[^/]*$', '') || substr(spec, 3) || ending AS path FROM i, (VALUES {', '.join(f"({n}, '{e}')" for n, e in enumerate(imports.SUFFIXES))}) s(n, ending) WHERE starts_with(spec, './')),
h AS (SELECT file, spec, min_by(path, n) AS resolved FROM c WHERE path IN (SELECT path FROM files) GROUP BY ALL) SELECT i.file, i.spec, h.resolved, CASE WHEN h.resolved IS NOT NULL THEN 'relative' END AS route FROM i LEFT JOIN h USING (file, spec)""")
def o109_imports(spark: SparkSession, root: str) -> DataFrame:
    """What the import specifiers of all scripts lead to."""
    f = table(spark, root, "files")
    specs = f.where(F.col("path").rlike(r"[.][jt]sx?$") & F.col("content").isNotNull()).select(F.col("path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(_SPEC.replace("''", "'")), 1)).alias("spec")).distinct()
    return imports.resolve_imports(specs, f.select("path"))
