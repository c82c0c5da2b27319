"""The registry: what the engine knows of entities, documents, claims, evidence and segments."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

#: Version written to ledgers.
SCHEMA_VERSION = "claim-registry/1"

# Claim states, each with the review state that belongs to it.
REVIEW_STATES = {"proposed": "needs_review", "accepted": "approved", "disputed": "conflict_open", "rejected": "rejected", "superseded": "archived"}

# Fields that every row of a registry needs.
REQUIRED = {
    "claims": ["claim_id", "subject_id", "predicate", "object_id", "subject_type", "object_type", "status", "confidence", "asserted_by", "source_document_id", "review_state"],
    "evidence": ["evidence_id", "claim_id", "source_document_id", "start_char", "end_char", "evidence_type", "support", "confidence", "excerpt", "captured_by"],
    "segments": ["segment_id", "document_id", "document_type", "text", "start_char", "end_char", "ordinal", "status", "text_hash", "segmenter_version"],
    "derived": ["edge_id", "source_claim_id", "rule_key", "subject_id", "predicate", "object_id", "status", "derived_at"],
}
# Fields that an accepted claim needs besides.
ACCEPTED_REQUIRED = ["reviewed_by", "reviewed_at", "decision_by", "decision_at", "decision_note"]


@dataclass(frozen=True)
class Registry:
    """Lazily read DataFrames, one a registry; manifests are small DataFrames like the others."""

    entities: DataFrame
    documents: DataFrame
    claims: DataFrame
    evidence: DataFrame
    segments: DataFrame
    relations: DataFrame
    rules: DataFrame
    document_types: DataFrame
    derived: DataFrame | None = None

    def with_derived(self, derived: DataFrame) -> Registry:
        return replace(self, derived=derived)
