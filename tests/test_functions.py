"""Scalar functions against known cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import expr
from lodestone.functions import text as tx


@pytest.mark.parametrize("name,want", [("load_db_config", ["load", "db", "config"]), ("readZipEntry", ["read", "zip", "entry"]), ("step7next", ["step", "7", "next"]), ("Load_DB_Config", ["load", "db", "config"]), ("read$zip-entry", ["read", "zip", "entry"]), ("", [])])
def test_tokens(spark, name, want):
    assert tx.tokenize(name) == want
    assert spark.createDataFrame([(name,)], "n string").select(expr.tokens(F.col("n"))).first()[0] == want


def test_similarity():
    assert tx.similarity("load_db_config", "LOAD_DB_CONFIG") == 1.0
    assert round(tx.jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(tx.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert tx.jaro("", "") == 1.0 and tx.jaro("a", "") == 0.0
    fam = [tx.similarity("load_db_config", x) for x in ("load_ui_config", "load_cli_config", "unrelated")]
    assert fam[0] > fam[2] and fam[1] > fam[2]


@settings(max_examples=200, deadline=None)
@given(st.text("abcde_", max_size=12), st.text("abcde_", max_size=12))
def test_bounds_never_lose_a_pair(a, b):
    s = tx.jaro_winkler(a, b)
    c, n = tx.profile([b])
    q, m = tx.profile([a])
    assert 0 <= s <= 1 and abs(s - tx.jaro_winkler(b, a)) < 1e-9
    if s >= 0.6 and a and b:
        assert tx.may_reach(q[0], int(m[0]), c, n, 0.6)[0]


@settings(max_examples=200, deadline=None)
@given(st.text("abcde_é", max_size=14), st.lists(st.text("abcde_é", max_size=14), max_size=6))
def test_many_at_once_equals_one_by_one(a, bs):
    n = np.array([len(b) for b in bs], np.int64)
    got = tx.jaro_winkler_many(a, tx.codes(bs, max([0, *n])), n)
    assert np.allclose(got, [tx.jaro_winkler(a, b) for b in bs])


@pytest.mark.parametrize("pattern,text,hit", [("*", "", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x*", "bx::y", True), ("[^a]x", "ax", False), ("a.c", "abc", False), ("Foo*", "foo", False), ("x[", "x[", True), ("*\\d*", "\\d", True), ("*a*", "b\na\n", True)])
def test_glob(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").select(expr.glob(F.col("t"), pattern)).first()[0] is hit


def test_paths_and_segments(spark):
    d = spark.createDataFrame([("src/a/b.rs",), ("crates/x/src/lib.rs",), ("a/index.ts",), ("",), (None,)], "p string")
    assert [r[0] for r in d.select(expr.module_path(F.col("p"))).collect()] == ["a::b", "", "a", "", None]
    d = spark.createDataFrame([("a::b::c",), ("a",), (None,)], "f string")
    assert [tuple(r) for r in d.select(expr.last_segment(F.col("f")), expr.parent(F.col("f")), expr.relative_to(F.col("f"), "a::b")).collect()] == [("c", "a::b", "c"), ("a", None, "a"), (None, None, None)]
    t = spark.createDataFrame([("a::tests::x", "s.rs"), ("a::tests", "s.rs"), ("a::b", "tests/x.rs"), ("a::b", "q\\tests\\x.rs"), ("a::b_test", None), ("a", "x.spec.tsx")], "f string, p string")
    assert [r[0] for r in t.select(expr.is_test(F.col("f"), F.col("p"))).collect()] == [True, True, False, True, True, True]
    assert [r[0] for r in t.select(expr.test_like_fqdn(F.col("f"), neighbour=True)).collect()][:2] == [True, False]


def test_limits():
    assert expr.clamp(None, 20, 1, 100) == 20 and expr.clamp(0, 20, 1, 100) == 1 and expr.clamp(900, 20, 1, 100) == 100
    assert expr.threshold(None, 0.6) == 0.6
    with pytest.raises(ValueError):
        expr.threshold(float("nan"), 0.6)


def test_source_slices():
    assert tx.leading_noise(["/// doc", "#[derive(", "  A,", ")]", "", "fn f() {}"]) == 5
    assert tx.leading_noise(["/* a", "b */", "x"]) == 2 and tx.leading_noise(["// only"]) == 1
    assert tx.strip_comments("let x = 1; // trailing comment\n") == "let x = 1; \n"
    assert tx.strip_comments('let s = "// no"; /* a\nb */ r#"/* x */"# `// t`') == 'let s = "// no"; \n r#"/* x */"# `// t`'
    assert tx.collapse_blanks("a\n\n \n\nb\n") == "a\n\nb\n"
    assert tx.compact_indent(["        fn deep() {", "            inner();", "                more();", "        }"]) == ("fn deep() {\n\tinner();\n\t\tmore();\n}", 8, "\t")
    assert tx.compact_indent([" a", "\t b"])[2] == "" and tx.compact_indent([]) == ("", 0, "")
    assert tx.slice_body("a\nb {\nc\n}", 2, 4, signature_only=True)["body"] == "b {" and tx.slice_body("a", 5, 9)["body"] == ""
    assert tx.line_column("a\n😀b", 3) == (2, 2) and tx.utf16_column("😀b", 1) == 2
    assert tx.nominal_head("&'a mut std::vec::Vec<u8>") == "Vec" and tx.generic_arguments("Map<K, Vec<(A, B)>>") == ["K", "Vec<(A, B)>"]
    assert tx.substitute_generics("Vec<T>", ["T"], ["u8"]) == "Vec<u8>"


def test_signature(spark):
    d = spark.sql("select 'f' n, named_struct('params', array(named_struct('name','a','ty','&  T','default',null), named_struct('name','b','ty',null,'default','1')), 'returns', 'R', 'is_async', true) s union all select 'g', null")
    assert [r[0] for r in d.select(expr.render_signature(F.col("n"), F.col("s"))).collect()] == ["async f(a: & T, b = 1) -> R", None]


def test_every_group_of_a_conditional_is_in_some_variant():
    from lodestone.functions.lexers import c_picks, lex_c

    text = "#ifdef A\nint a;\n#if B\nint b;\n#elif C\nint c;\n#else\nint e;\n#endif\n#else\nint z;\n#if 0\nno 'C\n#else\nint y;\n#endif\n#endif\n#ifdef X\nint x;\n#endif\n"
    met = {text[o : o + 1] for p in c_picks(text) for t, _, os in [lex_c(text, p)] for k, o in zip(t, os) if k == "IDENT"}
    assert met == set("abcezyx") and c_picks(text)[0] == () and c_picks("#if A\nint a;\n#endif\n") == [()]
    assert lex_c("#if A\nint a;\n")[0][-1] == "ERR" and lex_c("#else\n")[0][-1] == "ERR"
