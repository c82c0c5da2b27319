"""Deriving edges from accepted claims by declarative rules, one step forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unknown_predicates(rules: DataFrame, relations: DataFrame) -> DataFrame:
    """Rules that derive a relation that is not declared."""
    return rules.filter("materialize").join(relations.select(F.col("key").alias("derive_predicate")), "derive_predicate", "left_anti")


def derive(claims: DataFrame, rules: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """One edge for each accepted claim and rule of its predicate; of equal edge ids the last claim's stays.

    A rule takes the new edge's ends from the claim's ends, in either order; rules not to be
    materialised are passed over. With relations given, a rule that derives an undeclared one stops
    the run. The order of claims is their column ord.
    """
    active = rules.filter("materialize")
    if relations is not None:
        bad = unknown_predicates(rules, relations).select("key", "derive_predicate").take(1)
        if bad:
            raise ValueError(f"rule {bad[0].key} derives the undeclared relation {bad[0].derive_predicate}")
    active = active.select(F.col("key").alias("rule_key"), "source_predicate", "derive_predicate", "subject_from", "object_from")
    held = claims.filter("status = 'accepted'").join(active, F.col("predicate") == F.col("source_predicate"))
    end = lambda c: F.when(F.col(c) == "subject", F.col("subject_id")).otherwise(F.col("object_id"))
    edges = held.select(
        F.concat_ws(".", F.lit("edge"), "rule_key", "claim_id").alias("edge_id"), F.col("claim_id").alias("source_claim_id"), "rule_key", end("subject_from").alias("subject_id"),
        F.col("derive_predicate").alias("predicate"), end("object_from").alias("object_id"), F.lit("derived").alias("status"), "confidence", "valid_from", "valid_to", "ord",
    )
    latest = F.row_number().over(Window.partitionBy("edge_id").orderBy(F.desc("ord")))
    return edges.withColumn("nth", latest).filter("nth = 1").drop("nth", "ord")
