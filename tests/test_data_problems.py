"""Incremental work, orphan references and skewed keys on small tables with nulls, ties, repeats and clashing columns."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import heavy, ledger, orphans

RUNS = "run_id bigint, started_ms bigint, finished_ms bigint, status string"
ENTRIES = "item string, version string, token bigint, at_ms bigint"


def test_states_follow_the_greatest_committed_token(spark):
    runs = spark.createDataFrame([(1, 0, 1, "succeeded"), (2, 0, 1, "failed"), (3, 0, 1, "succeeded"), (4, 90, None, None), (5, 0, None, None), (None, 0, 1, "succeeded")], RUNS)
    entries = spark.createDataFrame(
        [("a", "1", 1, 5), ("a", "2", 3, 6), ("a", "1", 2, 99), ("b", "1", 1, 1), ("b", "2", 2, 2), ("c", "1", 4, 95), ("d", "1", 5, 1), ("e", "1", 77, 1), (None, "1", 1, 1), ("f", None, 3, 1), ("g", "1", 3, 1), ("g", "1", 3, 1)], ENTRIES)
    items = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1"), ("f", "1"), ("g", "1"), ("h", "1")], "item string, version string").withColumn("done", F.lit("clash"))
    got = {r.item: (r.state, r.token) for r in ledger.ledger_states(items, entries, ledger.lease_states(runs, now_ms=100, lease_ms=50)).collect()}
    # a: a later committed run wrote version 2, the stale writer of 2 and the older success are rejected.
    assert got["a"] == ("pending", None) and got["b"] == ("done", 1)
    assert got["c"] == ("leased", 4) and got["d"][0] == "pending"  # live lease; lease expired
    assert got["e"][0] == got["f"][0] == got["h"][0] == "pending" and got["g"] == ("done", 3)
    later = ledger.ledger_states(items, entries, ledger.lease_states(runs, now_ms=10_000, lease_ms=50))
    assert later.where("item = 'c'").first().state == "pending" and later.where("item='c'").first().done == "clash"


def test_ledger_hands_out_each_item_once_and_again_after_a_failure(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1")], "item string, version string")
    one, taken = book.lease(items, now_ms=0, lease_ms=100)
    assert {r.item for r in taken.collect()} == {"a", "b"}
    assert book.lease(items, now_ms=50, lease_ms=100)[1].count() == 0
    assert book.lease(items, now_ms=200, lease_ms=100)[1].count() == 2  # the first lease has expired
    assert book.commit(3, 210) and not book.commit(3, 220)
    assert book.lease(items, now_ms=230, lease_ms=100)[1].count() == 0
    more = items.unionByName(spark.createDataFrame([("a", "2")], "item string, version string"))
    assert [tuple(r) for r in book.lease(more, now_ms=240, lease_ms=100)[1].collect()] == [("a", "2")]
    assert one == 1


def test_stale_writer_is_fenced_and_retries_overwrite_their_own(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    items = spark.createDataFrame([("a", "1"), ("b", "1")], "item string, version string")
    old, _ = book.lease(items, 0, 100)
    assert book.write(old, items.withColumn("by", F.lit("old")))
    new, taken = book.lease(items, 150, 100)
    assert taken.count() == 2
    assert not book.commit(old, 160) and not book.write(old, items.withColumn("by", F.lit("stale")))
    for _ in range(2):  # a retry
        assert book.write(new, taken.withColumn("by", F.lit("new")))
    assert book.results("item string, version string, by string").count() == 0  # nothing is committed yet
    assert book.commit(new, 170)
    assert sorted(tuple(r) for r in book.results("item string, version string, by string").collect()) == [("a", "1", "new"), ("b", "1", "new")]
    assert book.compact() == new and book.compact() is None
    assert {r.state for r in book.states(items, 200, 100).collect()} == {"done"}
    assert not book.commit(99, 1)  # never leased


def test_two_coordinators_get_two_tokens(spark, tmp_path):
    a, b = (ledger.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))
    items = spark.createDataFrame([("a", "1")], "item string, version string")
    seen = a._numbers
    first, got = a.lease(items, 0, 100)
    b._numbers = lambda name, prefix="": [] if name == "leases" and b.stale else seen(name, prefix)  # reads before a's file was there
    b.stale = True
    token = None
    orig = b._create
    def create(name, content):
        ok = orig(name, content)
        b.stale = b.stale and not ok
        return ok
    b._create = create
    token, none = b.lease(items, 10, 100)
    assert (first, token) == (1, 2) and got.count() == 1 and none.count() == 0
    # A coordinator that has its token but no entries yet: the next one leaves everything to it until that lease expires.
    assert a._create("leases/3", {"started_ms": 20})
    more = items.unionByName(spark.createDataFrame([("z", "1")], "item string, version string"))
    assert a.lease(more, 30, 100)[1].count() == 0
    assert {r.item for r in a.lease(more, 500, 100)[1].collect()} == {"a", "z"}


def test_current_versions_and_paths(spark):
    f = spark.createDataFrame([("a/b.rs", "AB", 1), ("./a/b.rs", "cd", 2), ("a\\c.rs", None, 1), (None, "x", 9), ("ws:1:./q//r.rs", "e", 1), ("ws:1:./q//r.rs", "e", 1)], "path string, content_hash string, last_scanned_ms bigint")
    got = {r.item: (r.version, r.path) for r in ledger.current_versions(f).collect()}
    assert got == {"a/b.rs": ("cd", "./a/b.rs"), "a/c.rs": (None, "a\\c.rs"), "ws:1:q/r.rs": ("e", "ws:1:./q//r.rs")}
    assert ledger.current_versions(f.limit(0)).count() == 0
    # A null hash stays pending whatever was handled.
    e = ledger.scan_entries(spark.createDataFrame([(1, "a/c.rs", "z", 1)], "run_id bigint, path string, content_hash string, processed_ms bigint"))
    s = ledger.ledger_states(ledger.current_versions(f), e, ledger.lease_states(spark.createDataFrame([(1, 0, 1, "succeeded")], RUNS)))
    assert {r.state for r in s.where("item = 'a/c.rs'").collect()} == {"pending"}


EDGES = "workspace_id string, edge_id bigint, from_fqdn string, to_symbol_id bigint, to_unresolved string, recorded_ms bigint, scope string"
SYMS = "workspace_id string, fqdn string, symbol_id bigint, deleted_ms bigint"


def test_orphans_against_brute_force(spark):
    rnd = random.Random(3)
    names = [f"m::s{i}" for i in range(30)]
    syms = [(rnd.choice(["w", "v"]), n, i, rnd.choice([None, None, 5])) for i, n in enumerate(names)] + [("w", "m::s0", 0, 7), (None, "m::x", 99, None)]
    edges = [(rnd.choice(["w", "v", None]), i, rnd.choice([*names, "gone::a", None]), rnd.choice([None, *range(40)]), rnd.choice([None, "unwrap", "gone::b", *names]), i * 10**9, "clash") for i in range(300)]
    edges += edges[:20] + [("w", 1000 + i, "hot::orphan", None, "unwrap", 5, "clash") for i in range(150)]
    calls = [(i, rnd.choice([*names, "gone::c", None]), i) for i in range(100)]
    refs = orphans.references(spark.createDataFrame(edges, EDGES).drop("scope"), spark.createDataFrame(calls, "id bigint, from_fqdn string, recorded_ms bigint"))
    found = orphans.orphan_references(refs, orphans.parent_keys(spark.createDataFrame(syms, SYMS)))
    live = {(w, f) for w, f, _, d in syms if d is None}
    ids, anyw = {i for *_, i, d in syms if d is None}, {f for _, f in live}
    want = set()
    for w, i, fr, to, un, *_ in edges:
        if fr is not None and (w, fr) not in live or fr is not None and w is None:
            want.add(("edges", i, "from_fqdn"))
        if to is not None and to not in ids:
            want.add(("edges", i, "to_symbol_id"))
        if un and "::" in un and ((w, un) not in live or w is None):
            want.add(("edges", i, "to_unresolved"))
    want |= {("call_sites", i, "from_fqdn") for i, fr, _ in calls if fr is not None and fr not in anyw}
    assert {tuple(r) for r in orphans.orphan_records(found).collect()} == want
    rep = orphans.orphan_report(found)
    assert rep.agg(F.sum("orphans")).first()[0] == len(want)
    empty = orphans.orphan_references(refs.limit(0), orphans.parent_keys(spark.createDataFrame([], SYMS)))
    assert empty.count() == 0 and orphans.orphan_report(empty).count() == 0


def test_many_heavy_keys_are_all_found(spark):
    rows = [(f"k{i % 700}",) for i in range(35_000)] + [(f"x{i}",) for i in range(15_000)]
    df = spark.createDataFrame(rows, "k string")
    got = {r.k for r in heavy.heavy_keys(df, "k", share=0.001).collect()}
    assert got == {f"k{i}" for i in range(700)}
    assert heavy.sketch_size(0.001)[0] == 2000
    for bad in (0.0, -1, 1e-9, 2):
        with pytest.raises(ValueError):
            heavy.sketch_size(bad)


def test_semi_join_with_hot_keys(spark):
    big = spark.createDataFrame([(("hot" if i % 3 else f"k{i}") if i % 7 else None, i) for i in range(3000)], "k string, i int")
    keys = spark.createDataFrame([("hot",), ("k3",), ("none",), (None,)], "k string")
    want = {i for i in range(3000) if i % 7 and (i % 3 or i == 3)}
    for hot in (None, heavy.hot_keys(big.where("k is not null").groupBy("k").agg(F.count("*").alias("n")), ["k"])):
        assert {r.i for r in heavy.skew_safe_semi(big, keys, ["k"], F.col("i"), hot).collect()} == want
    assert heavy.skew_safe_semi(big.limit(0), keys, ["k"], F.col("i")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_heavy_keys_and_per_key(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot"] * 40 + ["warm"] * 3 + [None] + [f"k{i}" for i in range(60)]), rnd.choice([None, *"abcdefgh"]), rnd.choice([None, *range(50)])) for _ in range(n)]
    df = spark.createDataFrame(rows, "k0 string, m string, t bigint").withColumn("rows", F.lit(1))
    c = Counter(r[0] for r in rows if r[0] is not None)
    total = sum(c.values())
    assert {(r.k0, r.n, r.total) for r in heavy.heavy_keys(df, "k0").collect()} == {(k, v, total) for k, v in c.items() if v >= 0.02 * total}
    want = defaultdict(lambda: [0, set(), [], ])
    for k, m, t in rows:
        if k is not None:
            want[k][0] += 1
            want[k][1] |= {m} - {None}
            want[k][2] += [t] if t is not None else []
    got = {r.k0: (r.rows, r.members, r.first_ms, r.last_ms) for r in heavy.per_key(df, "k0", "m", "t").collect()}
    assert got == {k: (a, len(b), min(t, default=None), max(t, default=None)) for k, (a, b, t) in want.items()}
