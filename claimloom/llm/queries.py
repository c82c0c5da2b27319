"""The operators' registered queries: each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, filter_audit, jaccard, katz, media, mixing, quality, secret_scan, toxicity, urls, warc, wrappers
from .common import table


def tokenizer_path() -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("mined")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.fixity(spark, table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_jaccard_join, op3_html_extraction, op4_toxicity, op5_bpe, op6_mixing, op7_quality_rules, op8_media, op9_lm_scoring, op10_warc_fixity,
        op11_filter_audit, op12_secret_scan, op13_centroids,
    )
}
ORACLES: dict[str, str] = {
    "op1_url_filters": urls.oracle_sql(), "op2_jaccard_join": jaccard.oracle_sql(), "op6_mixing": mixing.oracle_sql(), "op10_warc_fixity": warc.oracle_sql(),
    "op11_filter_audit": filter_audit.oracle_sql(), "op12_secret_scan": secret_scan.oracle_sql(), "op13_centroids": centroids.oracle_sql(),
}
