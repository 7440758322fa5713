"""Queries of the text and source operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import docpairs, mixture, prose, sources, syntax, tokens


def _t(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return syntax.parsed(_t(spark, root, "files")).where("broken").select("path", "content_hash").distinct()


def p1_errors(spark: SparkSession, root: str) -> DataFrame:
    """Broken versions with the line of the first error no parse gets past."""
    return syntax.parsed(_t(spark, root, "files")).where("broken").select("path", "content_hash", "language", "error_line").distinct()


def p1_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of broken versions per project and language."""
    roots = sources.project_roots(_t(spark, root, "projects"), _t(spark, root, "workspace_catalog"))
    prefixes = spark.createDataFrame(roots, "prefix string, label string")
    return syntax.rates(syntax.parsed(_t(spark, root, "files")), prefixes)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return docpairs.documented(*[_t(spark, root, t) for t in ("body_slices", "symbols", "raw_documents")]).select("fqdn").distinct()


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """fqdn, code and description of each documented callable."""
    return docpairs.pairs(*[_t(spark, root, t) for t in ("body_slices", "symbols", "raw_documents")])


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_kinds(spark, root).select("path")


def p4_kinds(spark: SparkSession, root: str) -> DataFrame:
    """The paths that aren't hand-written source, with what they are."""
    return sources.not_handwritten(*[_t(spark, root, t) for t in ("files", "symbols", "projects", "workspace_catalog")])


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, ids of every document."""
    return tokens.encode(_t(spark, root, "documents"))


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, source, tokens, copies: the texts of the mixture."""
    targets = _t(spark, root, "mixture_targets")
    sized = mixture.sized_texts(_t(spark, root, "documents"), targets)
    return mixture.mix(sized, mixture.quotas(sized, targets))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Shares reached beside the wanted ones."""
    targets = _t(spark, root, "mixture_targets")
    sized = mixture.sized_texts(_t(spark, root, "documents"), targets)
    quota = mixture.quotas(sized, targets)
    return mixture.shares(mixture.mix(sized, quota), quota)


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return prose.not_prose(p9_stats(spark, root)).select("doc_id")


def p9_stats(spark: SparkSession, root: str) -> DataFrame:
    return prose.text_statistics(_t(spark, root, "documents"), _t(spark, root, "common_words"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_errors, p1_rates, p3_found, p3_pairs, p4_found, p4_kinds, p7_ids, p8_mix, p8_report, p9_found, p9_stats)}


def oracle_sql() -> dict[str, str]:
    return {}
