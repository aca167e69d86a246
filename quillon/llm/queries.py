"""The registered query of each training-data operator, and SQL that yields the same rows where SQL can.

Each applies its operator to whole tables with the parameters of production. Nulls, empty and long texts, ties,
repeated rows, empty tables and further columns are dealt with as the operator's docstring says; the queries add no rule of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, clusters, decontam, divergence, jaccard, langid, licences, mixing, quality, secrets_scan, sharding, toxicity, urls
from quillon.llm.common import table
from quillon.llm.oracle import ORACLE_SQL


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and component: :func:`jaccard.near_duplicates`."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score: :func:`toxicity.score`."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licence and notices: :func:`licences.scan`."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot: :func:`sharding.assign`."""
    return sharding.assign(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its votes: :func:`secrets_scan.scan`."""
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its verdict: :func:`urls.judge`."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item in it: :func:`decontam.matches`."""
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language: :func:`langid.identify`."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the digests of its tokens: :func:`bpe.encode_documents`."""
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict: :func:`quality.judge`."""
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster: :func:`clusters.cluster`."""
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes: :func:`mixing.mix`."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its divergence from the others and its most telling terms: :func:`divergence.audit`."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard, op2_toxicity, op3_licence_scan, op4_sharding, op5_secret_scan,
        op6_url_filter, op7_decontamination, op8_language_id, op9_bpe, op10_quality_rules,
        op11_clusters, op12_mixing, op13_divergence,
    )
}
