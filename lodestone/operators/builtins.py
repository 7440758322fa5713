"""Names a language brings along: their tier, their methods, bridges between languages, and symbols seeded for them.

All of it is a table, given as a parameter; :func:`registry` and :func:`methods` are the defaults. Tiers: ``drop`` (structural
noise, no edge), ``attribute`` (a flag on the source) and ``edge`` (an edge to a synthetic symbol).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names by language and tier.
NAMES = {
    "rust": {
        "edge": "Error",
        "attribute": "Iterator IntoIterator FromIterator Future Stream",
        "drop": "bool char str u8 u16 u32 u64 usize i8 i16 i32 i64 isize f32 f64 Box Rc Arc Pin Cell RefCell Mutex RwLock Vec VecDeque HashMap HashSet BTreeMap BTreeSet String PathBuf Path Option Result Cow Some None Ok Err Send Sync Sized Drop Clone Copy Default PartialEq Eq PartialOrd Ord Hash Debug Display From Into Fn FnMut FnOnce println format vec assert panic",
    },
    "typescript": {"edge": "Error TypeError RangeError JSON Math", "attribute": "Promise Iterator Iterable AsyncIterator", "drop": "Array Map Set Record Partial Object Number String Boolean Function"},
    "javascript": {"edge": "console window document JSON Math Proxy Reflect parseInt parseFloat", "drop": "undefined NaN Infinity Object Array Number String Boolean Map Set Promise"},
    "lua": {"edge": "print error pcall require io os", "drop": "pairs ipairs next type tostring tonumber select string table math"},
    "c": {"edge": "printf fprintf malloc calloc realloc free fopen fclose exit abort", "drop": "memcpy memset strlen strcmp assert size_t NULL"},
}
#: Methods of Rust's traits and of its common types.
TRAIT_METHODS = {
    "Clone": "clone clone_from", "Debug": "fmt", "Default": "default", "PartialEq": "eq ne", "PartialOrd": "partial_cmp lt le gt ge", "Ord": "cmp max min clamp", "Hash": "hash hash_slice",
    "Serialize": "serialize", "Deserialize": "deserialize", "Into": "into", "From": "from", "TryFrom": "try_from", "TryInto": "try_into", "FromStr": "from_str", "ToString": "to_string", "IntoIterator": "into_iter",
}
TYPE_METHODS = {
    "Vec": "push len is_empty clear contains extend sort insert pop first last get iter retain drain remove", "Option": "is_some is_none unwrap unwrap_or expect take map and_then filter ok_or",
    "Result": "is_ok is_err unwrap unwrap_or expect map map_err and_then ok", "String": "push push_str len is_empty as_str trim chars split parse", "HashMap": "insert get get_mut remove contains_key entry keys values iter len is_empty",
}


def synthetic(language, *names):
    """``<builtin>::language::name`` of columns."""
    return F.concat_ws("::", F.lit("<builtin>"), language, *names)


def registry(spark: SparkSession) -> DataFrame:
    """language, name, tier, synthetic_fqdn."""
    rows = [(lang, n, tier) for lang, tiers in NAMES.items() for tier, names in tiers.items() for n in names.split()]
    return spark.createDataFrame(rows, "language string, name string, tier string").withColumn("synthetic_fqdn", synthetic(F.col("language"), F.col("name")))


def methods(spark: SparkSession) -> DataFrame:
    """language, parent_type, method, is_trait, synthetic_fqdn."""
    rows = [("rust", t, m, trait) for table, trait in ((TRAIT_METHODS, True), (TYPE_METHODS, False)) for t, ms in table.items() for m in ms.split()]
    d = spark.createDataFrame(rows, "language string, parent_type string, method string, is_trait boolean")
    return d.withColumn("synthetic_fqdn", synthetic(F.col("language"), F.col("parent_type"), F.col("method")))


def seeds(names: DataFrame, method_table: DataFrame, workspace: str = "primary") -> DataFrame:
    """Symbol rows for built-in names and methods: external, at revision 0, under a virtual file per language, methods of traits
    flagged. The same rows each time, so writing them again changes nothing."""
    cols = "workspace_id string, fqdn string, name string, kind string, language_kind string, language string, module string, visibility string, receiver_type string, file_path string, is_external boolean, source_origin string, last_modified_revision bigint, flags array<string>"
    common = {"workspace_id": F.lit(workspace), "visibility": F.lit("public"), "file_path": F.concat(F.lit("<builtin>/"), "language"), "is_external": F.lit(True), "source_origin": F.lit("manual_external"), "last_modified_revision": F.lit(0).cast("bigint")}
    none = F.array().cast("array<string>")
    a = names.where("tier = 'edge'").select("language", F.col("synthetic_fqdn").alias("fqdn"), "name", F.lit("callable").alias("kind"), F.lit("builtin").alias("language_kind"), synthetic(F.col("language")).alias("module"), F.lit(None).cast("string").alias("receiver_type"), none.alias("flags"))
    b = method_table.select("language", F.col("synthetic_fqdn").alias("fqdn"), F.col("method").alias("name"), F.lit("callable").alias("kind"), F.lit("builtin_method").alias("language_kind"), synthetic(F.col("language"), F.col("parent_type")).alias("module"), F.col("parent_type").alias("receiver_type"), F.when(F.col("is_trait"), F.array(F.lit("trait_method"))).otherwise(none).alias("flags"))
    return a.unionByName(b).withColumns(common).select(*[c.split()[0] for c in cols.split(", ")]).dropDuplicates(["workspace_id", "fqdn"])


def bridged(requests: DataFrame, bridges: DataFrame) -> DataFrame:
    """requests (source, target, name) with ``mapped``: the first mapping (by ordinal) of a name between two substrates, null
    where there is none. bridges: source, target, ordinal, name, mapped."""
    first = bridges.groupBy("source", "target", "name").agg(F.min_by("mapped", "ordinal").alias("mapped"))
    return requests.join(first, ["source", "target", "name"], "left").select("source", "target", "name", "mapped")
