"""The training-data pipeline: five stages over documents, each written and read by the next.

toxicity (reject), quality rules (reject), n-gram Jaccard join (one document of each group stays),
mixing sources to target weights (documents repeat or go), BPE encoding (token ids).

Defined cases: null, empty and wordless texts fail the quality rules; very long texts are judged,
compared, mixed and encoded whole; null ids are kept, and rows of one id are told apart by their
texts; of equal rows one stays; a null source is a source of its own; empty tables give empty tables;
other columns, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import bpe, jaccard, mixing, quality, toxicity
from claimloom.llm.common import Scratch, table
from claimloom.llm.queries import tokenizer_path


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids of every document of the mix."""
    out = bpe.encode(docs.select("doc_id", "source", "text"), tokenizer_path())
    return out.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("quality_rules", of_good_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("mixing", mixed),
    ("bpe", encoded),
]

#: The model-based stages cannot be put in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
