"""Exact lookups, listings, globs and full-text search over symbols, for many requests at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import expr

PAGE = 100


def symbol_filter(kind: str | None = None, visibility: str | None = None, module: str | None = None, include_external: bool = True, workspace: str | None = "primary") -> Column:
    """Only the predicates that are set, so each can reach the scan. ``workspace=None`` looks everywhere."""
    c = F.lit(True)
    for name, v in (("kind", kind), ("visibility", visibility), ("module", module), ("workspace_id", workspace)):
        if v is not None:
            c = c & (F.col(name) == v)
    return c if include_external else c & ~F.coalesce(F.col("is_external"), F.lit(False))


def lookup(requests: DataFrame, symbols: DataFrame, *cols: str) -> DataFrame:
    """requests (workspace_id, fqdn) with the named symbol columns and ``found``; a missing symbol keeps its request."""
    s = symbols.select("workspace_id", "fqdn", *cols, F.lit(True).alias("found"))
    return requests.join(s, ["workspace_id", "fqdn"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def first_per(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows per group in a total order, with their rank. Spark prunes groups before the shuffle
    (WindowGroupLimit), so a group that holds a third of all rows sends ``n`` rows per task."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def page(symbols: DataFrame, where: Column, cursor: str | None = None, limit: int = PAGE) -> DataFrame:
    """Keyset page in fqdn order behind ``cursor``; ``next_cursor`` is set on every row iff the page is full."""
    c = where if cursor is None else where & (F.col("fqdn") > cursor)
    p = symbols.where(c).orderBy("fqdn", "workspace_id").limit(limit)
    full = p.agg(F.max("fqdn").alias("last"), F.count("*").alias("n"))
    return p.crossJoin(F.broadcast(full)).withColumn("next_cursor", F.when(F.col("n") == limit, F.col("last"))).drop("last", "n")


def with_fallback(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """requests (fqdn) with ``hit``: the name itself if it is a symbol, else with ``.`` read as ``::``, else null."""
    known = symbols.select(F.col("fqdn").alias("k")).distinct()
    r = requests.withColumn("norm", F.regexp_replace("fqdn", r"\.", "::"))
    a = r.join(known.withColumnRenamed("k", "raw_hit"), F.col("fqdn") == F.col("raw_hit"), "left")
    b = a.join(known.withColumnRenamed("k", "norm_hit"), F.col("norm") == F.col("norm_hit"), "left")
    return b.select("fqdn", F.coalesce("raw_hit", "norm_hit").alias("hit"))


def postings(docs: DataFrame, key: list[str], text: Column) -> DataFrame:
    """Inverted index: key, term, tf, doc_len. Terms fold per document before anything is shuffled."""
    t = docs.select(*key, expr.search_terms(text).alias("terms")).where(F.size("terms") > 0)
    return t.select(*key, F.size("terms").alias("doc_len"), F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))


def search(docs: DataFrame, key: list[str], text: Column, requests: DataFrame, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """request_id, key, score, rank: documents with all terms of the request; where there is none and the request has
    several terms, those with any. Ranked by BM25 (smallest idf 1e-6), ties by key.

    Words of a request are split as texts are, so ``load_db`` asks for both parts side by side (checked against the text).
    """
    post = postings(docs, key, text)
    stats = docs.select(F.size(expr.search_terms(text)).alias("n")).where("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("avgdl"))
    req = requests.select("request_id", F.array_distinct(expr.search_terms(F.col("query"))).alias("terms"), F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}_]+"), lambda x: F.contains(x, F.lit("_"))).alias("phrases"))
    terms = req.select("request_id", F.size("terms").alias("want"), F.explode("terms").alias("term"))
    hits = post.join(terms, "term")
    df = post.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
    per = scored.groupBy("request_id", *key).agg(F.sum(part).alias("score"), F.count("*").alias("have"), F.first("want").alias("want")).withColumn("all_terms", F.col("have") == F.col("want"))
    # Only the hits of requests with phrases meet the texts again.
    phrased = req.where(F.size("phrases") > 0).select("request_id", "phrases")
    padded = docs.select(*key, F.concat(F.lit(" "), F.array_join(expr.search_terms(text), " "), F.lit(" ")).alias("flat"))
    adjacent = F.forall("phrases", lambda p: F.contains(F.col("flat"), F.concat(F.lit(" "), F.array_join(F.filter(F.split(p, "_"), lambda x: x != ""), " "), F.lit(" "))))
    checked = per.join(phrased, "request_id").join(padded, key).where(adjacent).select(*per.columns)
    per = per.join(phrased.select("request_id"), "request_id", "left_anti").select(*per.columns).unionByName(checked)
    # Whether a request has a full hit is a partial aggregate, so no task gathers all hits of a common word.
    full = per.groupBy("request_id").agg(F.max("all_terms").alias("any_full"))
    kept = per.join(full, "request_id").where(F.col("all_terms") | ~F.col("any_full"))
    # Equal scores may differ in their last bits by the order of summation; ties go by key.
    return first_per(kept, ["request_id"], [F.desc(F.round("score", 9)), *key], limit).select("request_id", *key, F.round("score", 6).alias("score"), "rank")


def envelopes(requests: DataFrame, hits: DataFrame, shown: int = 20, lean_above: int = 15) -> DataFrame:
    """query, hits, mode, body: the JSON answer to each request (query), from hits (query, fqdn): the count of all hits and the
    first ``shown`` names. ``mode`` is empty, full, or lean where there are more than ``lean_above``. Only shown names are ever
    gathered; the count is a partial aggregate."""
    n = hits.groupBy("query").agg(F.count("*").alias("hits"))
    names = first_per(hits, ["query"], ["fqdn"], shown).groupBy("query").agg(F.sort_array(F.collect_list("fqdn")).alias("results"))
    j = requests.join(n, "query", "left").join(names, "query", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("bigint")))
    body = F.to_json(F.struct("query", F.col("hits").alias("count"), F.coalesce("results", F.array().cast("array<string>")).alias("results")))
    return j.select("query", "hits", F.when(F.col("hits") > lean_above, "lean").when(F.col("hits") > 0, "full").otherwise("empty").alias("mode"), body.alias("body"))


def call_sites(calls: DataFrame, from_fqdn: str | None = None, callee: str | None = None, pattern: str | None = None, limit: int | None = None) -> DataFrame:
    """Call sites by any of three conditions, oldest id first; 50 by default, 200 at most, limit 0 gives none."""
    n = 50 if limit is None else max(0, min(200, limit))
    c = F.lit(True)
    if from_fqdn is not None:
        c = c & (F.col("from_fqdn") == from_fqdn)
    if callee is not None:
        c = c & (F.col("callee_text") == callee)
    if pattern is not None:
        c = c & expr.glob(F.col("callee_text"), pattern)
    return calls.where(c).orderBy("id").limit(n)
