"""Conversations as Markdown documents: a heading for each turn, its text below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, document_type, status, text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    head = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), F.coalesce("role", F.lit("none")))
    piece = F.concat(head, F.lit("\n\n"), F.coalesce("text", F.lit("")))
    whole = F.array_sort(F.collect_list(F.struct("turn", piece.alias("piece"))))
    joined = turns.groupBy("conv_id").agg(F.array_join(F.transform(whole, lambda x: x.piece), "\n\n").alias("text"))
    return joined.select(F.concat(F.lit("conv."), F.col("conv_id").cast("string")).alias("document_id"), F.lit("conversation").alias("document_type"), F.lit("active").alias("status"), "text")
