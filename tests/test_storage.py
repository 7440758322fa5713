"""Storage verbs, built-ins, import resolution and streamed snapshots on small tables with nulls, repeats and empty inputs."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import builtins, extract, imports, resolve, storage
from lodestone.streaming import live

CATALOG = "workspace_id string, root_path string, link_direction int, status string"


def test_catalog_verbs(spark):
    c = spark.createDataFrame([("primary", "/p", 2, "active"), ("a", "/a", 0, "paused")], CATALOG)
    more = storage.register(c, spark.createDataFrame([("b", "/a", 1, "active"), ("a", "/else", 1, "lost")], CATALOG))
    assert {tuple(r) for r in more.collect()} == {("primary", "/p", 2, "active"), ("a", "/a", 0, "paused"), ("b", "/a", 1, "active")}
    ch = spark.createDataFrame([("a", 1, None), ("b", 7, "archived"), ("zz", 1, "x")], "workspace_id string, link_direction int, status string")
    assert {(r.workspace_id, r.link_direction, r.status) for r in storage.set_fields(more, ch).collect()} == {("primary", 2, "active"), ("a", 1, "paused"), ("b", 1, "archived")}
    left = storage.unlink({"c": more}, spark.createDataFrame([("a",), ("primary",)], "workspace_id string"))["c"]
    assert {r.workspace_id for r in left.collect()} == {"primary", "b"}
    fresh = spark.createDataFrame([("b", "/new", 0, "active"), ("other", "/o", 0, "active")], CATALOG)
    assert {(r.workspace_id, r.root_path) for r in storage.refresh(more, fresh, "b").collect()} == {("primary", "/p"), ("a", "/a"), ("b", "/new")}


def test_enrichments_refuse_unknown_confidence_and_keep_the_last(spark):
    new = spark.createDataFrame([("w", "a", "one", "low", 1), ("w", "a", "two", "high", 2), ("w", "b", "x", "sure", 3), ("w", "c", "y", None, 4)], "workspace_id string, fqdn string, summary string, confidence string, at int")
    old = spark.createDataFrame([("w", "a", "zero", "medium"), ("w", "d", "kept", "low")], "workspace_id string, fqdn string, summary string, confidence string")
    assert {tuple(r) for r in storage.enrich(old, new, order=("at",)).collect()} == {("w", "a", "two", "high"), ("w", "d", "kept", "low")}


def test_projects(spark):
    p = spark.createDataFrame([(1, "a", "rust", "/a", "a"), (2, "b", "lua", "/b", "b")], "project_id int, label string, kind string, root_path string, rel_path string")
    new = spark.createDataFrame([(None, "A", "rust", "/a", "a"), (None, "n", "node", "/n", "n"), (None, "m", "node", "/m", "m"), (None, "m", "node", "/m", "m")], p.schema)
    assert {(r.project_id, r.label) for r in storage.upsert_projects(p, new).collect()} == {(1, "A"), (2, "b"), (3, "m"), (4, "n")}
    f = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "path string, project_id int")
    left, files = storage.delete_projects(p, f, F.col("kind") == "lua")
    assert {r.project_id for r in left.collect()} == {1} and {tuple(r) for r in files.collect()} == {("x", 1), ("y", None), ("z", None)}
    found = spark.createDataFrame([("a", "rust", "a")], "rel_path string, kind string, label string")
    none = spark.createDataFrame([("a/main.rs",)], "path string")
    same, kept = storage.rediscover(p, found, f, none, ["Cargo.toml"])  # no manifest was touched
    assert same.count() == 2 and {tuple(r) for r in kept.collect()} == {("x", 1), ("y", 2), ("z", None)}


def test_positions_and_index(spark):
    s = spark.createDataFrame([("a", 1, 2, 3, 4, 7), ("b", 1, 1, 1, 1, 8)], "fqdn string, start_line int, end_line int, start_col int, end_col int, rev int")
    n = spark.createDataFrame([("a", 5, None, 0, None), ("zz", 1, 1, 1, 1)], "fqdn string, start_line int, end_line int, start_col int, end_col int")
    assert {tuple(r) for r in storage.move_positions(s, n, ["fqdn"]).collect()} == {("a", 5, 2, 0, 4, 7), ("b", 1, 1, 1, 1, 8)}
    d = spark.createDataFrame([("w", "a", "load file"), ("w", "b", "load")], "workspace_id string, fqdn string, name string")
    from lodestone.operators.lookup import postings

    old = postings(d.where("fqdn = 'a'"), ["workspace_id", "fqdn"], F.col("name"))
    assert {(r.term, r.sound) for r in storage.index_check(d, old, F.col("name")).collect()} == {("load", False), ("file", True)}


def test_builtins(spark):
    reg, meth = builtins.registry(spark), builtins.methods(spark)
    assert reg.groupBy("language", "name").count().where("count > 1").count() == 0 and reg.count() + meth.count() < 260
    s = builtins.seeds(reg, meth)
    assert s.where("fqdn = '<builtin>::rust::Clone::clone' and array_contains(flags, 'trait_method')").count() == 1
    e = spark.createDataFrame([(1, "rust", "Vec"), (2, "rust", "Iterator"), (3, "javascript", "JSON"), (4, "rust", "mine"), (5, None, "Vec"), (6, "rust", None)], "edge_id int, language string, name string")
    got = {r.edge_id: (r.tier, r.to_fqdn, r.flag) for r in resolve.builtin_tier(e, reg).collect()}
    assert got == {1: ("drop", None, None), 2: ("attribute", None, "builtin-iterator"), 3: ("edge", "<builtin>::javascript::JSON", None), 4: ("none", None, None), 5: ("none", None, None), 6: ("none", None, None)}


def test_extracted_edges_by_tier(spark):
    f = spark.createDataFrame([("src/a.rs", "fn f(x: Vec<u8>, it: Iterator) -> Error { println!(x); Some(1) }\nimpl Error for A {}\n", "p")], "path string, content string, project string")
    x = extract.with_builtins(extract.extract(f), builtins.registry(spark)).where("what = 'edge'")
    got = {(r.kind, r.target, r.attribute) for r in x.collect()}
    assert ("USES_TYPE", "<builtin>::rust::Error", "type-annotation") in got and ("USES_TYPE", "Iterator", "type-annotation,builtin-iterator") in got and ("IMPLEMENTS", "<builtin>::rust::Error", None) in got
    assert not any(t in ("Vec", "println", "Some") for _, t, _ in got)


@pytest.mark.parametrize("text,want", [
    ('{"compilerOptions": {"paths": {"@a/*": ["x/*"]}}}', [(0, "@a/", "", "./x/*")]), ('{// c\n"compilerOptions": {"baseUrl": "src", "paths": {"u": ["v",],},},}', [(0, "u", None, "src/v")]),
    ('{"compilerOptions": {"baseUrl": "http://x"}}', []), ("not json", []), (None, []), ("[]", []), ('{"compilerOptions": {"paths": {"a": "b", "c": [1]}}}', []),
])
def test_path_rules(text, want):
    assert imports.path_rules(text) == want


def test_imports_without_files_or_specifiers(spark):
    i = spark.createDataFrame([("a.ts", "./b"), (None, "./b"), ("a.ts", None), ("x/a.ts", "../../../b"), ("a.ts", "./b")], "file string, spec string")
    f = spark.createDataFrame([("b.ts",), ("b/index.ts",)], "path string")
    assert {tuple(r) for r in imports.resolve_imports(i, f).collect()} == {("a.ts", "./b", "b.ts", "relative"), ("x/a.ts", "../../../b", "b.ts", "relative")}
    assert {tuple(r) for r in imports.resolve_imports(i, f.limit(0)).collect()} == {("a.ts", "./b", None, None), ("x/a.ts", "../../../b", None, None)}
    assert imports.resolve_imports(i.limit(0), f).count() == 0


def test_snapshots_rewrite_touched_buckets_only(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path / "snap")
    schema = "path string, h string, ms bigint"
    spark.createDataFrame([(f"p{i}", "1", 1) for i in range(200)], schema).coalesce(1).write.parquet(f"{src}/one")

    def run():
        live.follow(spark, f"{src}/*", schema, base, ["path"], ["ms", "h"], trigger={"availableNow": True}, buckets=16).awaitTermination()
        return {r.path: (r.h, r.ms) for r in live.snapshot(spark, base, schema).collect()}

    assert len(run()) == 200
    for n in range(2, 6):
        spark.createDataFrame([("p7", str(n), n), ("p7", "late", 0)], schema).coalesce(1).write.parquet(f"{src}/n{n}")
        got = run()
        assert got["p7"] == (str(n), n) and len(got) == 200
    versions = live._versions(spark, base)
    assert len(versions[max(versions)]) == 1  # the last batch wrote one bucket
    assert sum(map(len, versions.values())) < 16 + len(versions) + 2  # replaced buckets are gone
    assert live.snapshot(spark, str(tmp_path / "nothing"), schema).count() == 0


def test_configuration_is_strict_and_takes_over_old_ignore_files():
    from lodestone.sources import workspace

    c = workspace.parse_config('version = 1\nignore {\n  target/\n}\nproject "core" "crates/core" { kind = "rust" }\nviz {\n  port = 80\n}\n')
    assert c["ignore"] == ["target/"] and c["project"][0]["args"] == ["core", "crates/core"] and c["viz"][0]["port"] == "80"
    for bad in ('extra { a }', 'colour = "red"\n', 'project "a" { size = 3 }', 'viz { host = "x" }', "ignore {"):
        with pytest.raises(ValueError):
            workspace.parse_config(bad)
    assert workspace.parse_config("extra {\n a\n}\n", strict=False)["extra"][0]["lines"] == ["a"]
    assert workspace.parse_config(workspace.legacy_config("# old\ntarget/\n\n*.min.js\n"))["ignore"] == ["target/", "*.min.js"]


def test_discovery_by_manifest(spark):
    from lodestone.sources import workspace

    p = spark.createDataFrame([("a/Cargo.toml",), ("a/CMakeLists.txt",), ("a/src/x.c",), ("b/CMakeLists.txt",), ("b/include/deep/y.hpp",), ("b/src/z.c",), ("c/CMakeLists.txt",), ("c/other/z.c",), ("d/CMakeLists.txt",), ("d/lib/z.c",), ("e/x-1.rockspec",), ("f/package.json",), ("f/bun.lockb",), (None,)], "path string")
    assert {(r.rel_path, r.kind) for r in workspace.discover_projects(p).collect()} == {("a", "rust"), ("b", "cpp"), ("d", "c"), ("e", "lua"), ("f", "bun")}
    assert workspace.discover_projects(p.limit(0)).count() == 0
