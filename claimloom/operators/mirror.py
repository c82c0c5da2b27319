"""Mirroring registries into relational tables, with a ledger of what they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.registry import SCHEMA_VERSION, Registry
from claimloom.sources import shared

# The mirror's tables, and of each its typed columns; a column that is named otherwise in the registry has that name beside it.
COLUMNS = {
    "relations": ["relation_key", "label", "group_name"],
    "document_types": ["document_type_key", "label", "default_claim_status"],
    "entities": ["entity_id", "entity_type", "label", "status"],
    "documents": ["document_id", "path", "document_type", "status"],
    "claims": ["claim_id", "subject_id", "predicate", "object_id", "status", "review_state", "source_document_id"],
    "claim_evidence": ["evidence_id", "claim_id", "source_document_id", "support"],
    "segments": ["segment_id", "document_id", "document_type", "status", "ordinal"],
    "derived_edges": ["edge_id", "source_claim_id", "rule_key", "subject_id", "predicate", "object_id", "status"],
}
SOURCES = {"relation_key": "key", "group_name": "group", "document_type_key": "key"}
#: Columns that readers of files add: where a row stood, and its text.
READ = ("ord", "raw")
#: The registry's names of those tables that it calls otherwise.
ATTRIBUTES = {"claim_evidence": "evidence", "derived_edges": "derived"}


def rows_of(registry: Registry, name: str) -> DataFrame | None:
    return getattr(registry, ATTRIBUTES.get(name, name))


def mirror_table(registry: Registry, name: str) -> DataFrame:
    """The typed columns (absent ones empty, ordinal a number) and the whole row as JSON, by names in order."""
    rows = rows_of(registry, name)

    def column(c: str) -> Column:
        source = SOURCES.get(c, c)
        if c == "ordinal":
            return F.coalesce(F.col(source).try_cast("bigint"), F.lit(0)).cast("bigint").alias(c)
        return (F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")) if source in rows.columns else F.lit("")).alias(c)

    payload = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns) if c not in READ)), {"ignoreNullFields": "false"}).alias("payload_json")
    return rows.select(*map(column, COLUMNS[name]), payload)


def counts(registry: Registry) -> DataFrame:
    """source_path, row_count, schema_version of each table that there is."""
    out = None
    for name in COLUMNS:
        rows = rows_of(registry, name)
        if rows is not None:
            part = rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("source_path"), "row_count", F.lit(SCHEMA_VERSION).alias("schema_version"))
            out = part if out is None else out.unionByName(part)
    return out


def state(registry: Registry, hashes: DataFrame | None = None) -> DataFrame:
    """What a ledger holds of each table: counts() with source_hash, of its files (fingerprint.of_sources) or else of its rows in any order."""
    if hashes is not None:
        return counts(registry).join(hashes, "source_path", "left")
    out = None
    for name in COLUMNS:
        if rows_of(registry, name) is not None:
            # One look at the rows for count and hash; hashes of rows are added up, so that equal rows count as often as they are there.
            row = F.xxhash64("payload_json").cast("decimal(38,0)")
            part = mirror_table(registry, name).agg(F.count(F.lit(1)).alias("row_count"), F.sum(row).alias("h"))
            part = part.select(F.lit(name).alias("source_path"), "row_count", F.lit(SCHEMA_VERSION).alias("schema_version"), F.concat_ws(":", "row_count", F.coalesce("h", F.lit(0)).cast("string")).alias("source_hash"))
            out = part if out is None else out.unionByName(part)
    return out


def sync(registry: Registry, folder: str, hashes: DataFrame | None = None) -> DataFrame:
    """Write every table and then the ledger; returns the ledger. hashes: as state() takes them.

    Each run writes to a folder of its own and the ledger comes last, so a reader that goes by the
    ledger never sees tables of two runs. The sources' state is taken before their rows are read.
    """
    import uuid

    spark = registry.claims.sparkSession
    run = f"{folder}/run-{uuid.uuid4().hex}"
    found = shared.written(state(registry, hashes), "mirror-state")
    for name in COLUMNS:
        if rows_of(registry, name) is not None:
            mirror_table(registry, name).write.parquet(f"{run}/{name}")
    ledger = found.withColumns({"synced_at": F.current_timestamp(), "location": F.concat(F.lit(f"{run}/"), "source_path")})
    ledger.write.mode("overwrite").parquet(f"{folder}/_ledger")
    return spark.read.parquet(f"{folder}/_ledger")


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The mirror's ledger; None where there is no mirror. What cannot be read as one raises."""
    if not shared.exists(spark, folder):
        return None
    return spark.read.parquet(f"{folder}/_ledger").select("source_path", "source_hash", "row_count", "schema_version")
