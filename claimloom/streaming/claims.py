"""Claims as a stream: edges derived as claims arrive, and counts by window of their validity.

An extension: the batch operators are the engine. State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimloom.functions.text import moment


def derive_stream(claims: DataFrame, rules: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Edges of arriving accepted claims; the first of an edge id within the watermark counts."""
    active = rules.filter("materialize").select(F.col("key").alias("rule_key"), "source_predicate", "derive_predicate", "subject_from", "object_from")
    held = claims.filter("status = 'accepted'").withColumn("at", moment(F.col("valid_from"))).withWatermark("at", lateness).join(active, F.col("predicate") == F.col("source_predicate"))
    end = lambda c: F.when(F.col(c) == "subject", F.col("subject_id")).otherwise(F.col("object_id"))
    edges = held.select(F.concat_ws(".", F.lit("edge"), "rule_key", "claim_id").alias("edge_id"), F.col("claim_id").alias("source_claim_id"), "rule_key", end("subject_from").alias("subject_id"), F.col("derive_predicate").alias("predicate"), end("object_from").alias("object_id"), "at")
    return edges.dropDuplicatesWithinWatermark(["edge_id"])


def claims_by_window(claims: DataFrame, width: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """start, status, n of claims that become valid in a window; windows close by the watermark."""
    timed = claims.withColumn("at", moment(F.col("valid_from"))).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def keep_latest(claims: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each batch's claims, the last of each id, into a folder of its own; a batch tried again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("claim_id").agg(F.max_by(F.struct(*batch.columns), "ord").alias("r")).select("r.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return claims.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
