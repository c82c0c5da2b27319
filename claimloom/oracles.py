"""SQL for DuckDB of the registered queries: written against the tables, not against our plans."""

from __future__ import annotations

from claimloom.plans.registry import ACCEPTED_REQUIRED, REQUIRED, REVIEW_STATES
from claimloom.plans.star import prelude

_STATES = ", ".join(f"'{s}'" for s in REVIEW_STATES)
_KEYED = """,
kclaims AS (SELECT * FROM claims WHERE coalesce(claim_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY ord) = 1),
okclaims AS (SELECT * FROM kclaims WHERE status IN ({states})),
kevidence AS (SELECT * FROM evidence WHERE coalesce(evidence_id, '') <> '' QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ord) = 1),
ksegments AS (SELECT * FROM segments WHERE coalesce(segment_id, '') <> ''),
placed AS (SELECT s.*, d.document_type AS of_type, d.text AS body FROM ksegments s JOIN docs d ON d.document_id = s.document_id AND s.document_id <> ''),
spans AS (SELECT e.*, s.start_char AS seg_start, s.end_char AS seg_end FROM kevidence e JOIN ksegments s ON s.segment_id = e.source_segment_id AND e.source_segment_id <> ''),
derived AS (SELECT 'edge.' || r.key || '.' || c.claim_id AS edge_id, c.claim_id AS source_claim_id, r.key AS rule_key,
  CASE WHEN r.subject_from = 'subject' THEN c.subject_id ELSE c.object_id END AS subject_id, r.derive_predicate AS predicate,
  CASE WHEN r.object_from = 'subject' THEN c.subject_id ELSE c.object_id END AS object_id, 'derived' AS status, c.confidence, c.valid_from, c.valid_to
  FROM claims c JOIN rules r ON r.source_predicate = c.predicate WHERE c.status = 'accepted' AND r.materialize
  QUALIFY row_number() OVER (PARTITION BY 'edge.' || r.key || '.' || c.claim_id ORDER BY c.ord DESC) = 1)
""".replace("{states}", _STATES)


def sql(body: str) -> str:
    """The registry's views, rows by key, derived edges, and the query."""
    return prelude() + _KEYED + body.strip()


def _fields(table: str, key: str, fields: list[str], where: str = "true") -> str:
    return " UNION ALL ".join(f"SELECT {key} AS record, '{f}' AS detail FROM {table} WHERE ({where}) AND coalesce({f}::VARCHAR, '') = ''" for f in fields)


def _dangling(table: str, key: str, column: str, parent: str, parent_key: str) -> str:
    return f"SELECT {key} AS record, {column} AS detail FROM {table} t WHERE coalesce({column}, '') <> '' AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = t.{column})"


_TABLES = {"claims": ("claims", "claim_id"), "evidence": ("evidence", "evidence_id"), "segments": ("segments", "segment_id"), "entities": ("entities", "entity_id"), "documents": ("docs", "document_id")}

#: code -> (level, SELECT record, detail)
ISSUES: dict[str, tuple[str, str]] = {}
for _name, (_table, _key) in _TABLES.items():
    ISSUES[f"{_name}.missing_key"] = ("error", f"SELECT '' AS record, count(*)::VARCHAR AS detail FROM {_table} WHERE coalesce({_key}, '') = '' HAVING count(*) > 0")
    ISSUES[f"{_name}.duplicate_key"] = ("error", f"SELECT {_key} AS record, (count(*) - 1)::VARCHAR AS detail FROM {_table} WHERE coalesce({_key}, '') <> '' GROUP BY {_key} HAVING count(*) > 1")
for _name in ("claims", "evidence", "segments"):
    ISSUES[f"{_name}.missing_field"] = ("error", _fields(f"k{_name}", _TABLES[_name][1], REQUIRED[_name]))
ISSUES |= {
    "document_types.invalid_default_claim_status": ("error", "SELECT key AS record, default_claim_status AS detail FROM document_types WHERE default_claim_status IS DISTINCT FROM 'proposed'"),
    "documents.missing_type": ("error", "SELECT document_id AS record, '' AS detail FROM docs WHERE coalesce(document_type, '') = ''"),
    "documents.unknown_type": ("error", _dangling("docs", "document_id", "document_type", "document_types", "key")),
    "segments.unknown_document": ("error", "SELECT segment_id AS record, document_id AS detail FROM ksegments WHERE document_id NOT IN (SELECT document_id FROM docs)"),
    "segments.document_type_mismatch": ("error", "SELECT segment_id AS record, of_type AS detail FROM placed WHERE document_type <> '' AND of_type <> '' AND document_type <> of_type"),
    "segments.invalid_numeric_field": ("error", "SELECT segment_id AS record, '' AS detail FROM placed WHERE start_char IS NULL OR end_char IS NULL OR ordinal IS NULL"),
    "segments.invalid_offsets": ("error", "SELECT segment_id AS record, '' AS detail FROM placed WHERE start_char > end_char"),
    "segments.text_hash_mismatch": ("error", "SELECT segment_id AS record, '' AS detail FROM placed WHERE sha256(text) IS DISTINCT FROM text_hash"),
    "segments.out_of_bounds": ("error", "SELECT segment_id AS record, '' AS detail FROM placed WHERE end_char > length(body)"),
    "segments.text_mismatch": ("error", "SELECT segment_id AS record, '' AS detail FROM placed WHERE end_char <= length(body) AND substr(body, start_char + 1, greatest(end_char - start_char, 0)) <> text"),
    "claims.invalid_status": ("error", f"SELECT claim_id AS record, status AS detail FROM kclaims WHERE status IS NULL OR status NOT IN ({_STATES})"),
    "claims.invalid_review_state": ("error", "SELECT claim_id AS record, review_state AS detail FROM okclaims WHERE review_state IS DISTINCT FROM CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REVIEW_STATES.items()) + " END"),
    "claims.unknown_relation": ("error", _dangling("okclaims", "claim_id", "predicate", "relations", "key")),
    "claims.unknown_subject": ("error", _dangling("okclaims", "claim_id", "subject_id", "entities", "entity_id")),
    "claims.unknown_object": ("error", _dangling("okclaims", "claim_id", "object_id", "entities", "entity_id")),
    "claims.unknown_document": ("error", _dangling("okclaims", "claim_id", "source_document_id", "docs", "document_id")),
    "claims.invalid_segment_id": ("error", "SELECT claim_id AS record, source_segment_id AS detail FROM okclaims WHERE typeof(source_segment_id) <> 'VARCHAR'"),
    "claims.unknown_segment": ("error", _dangling("okclaims", "claim_id", "source_segment_id", "segments", "segment_id")),
    "claims.segment_document_mismatch": ("error", "SELECT claim_id AS record, s.document_id AS detail FROM okclaims c JOIN ksegments s ON s.segment_id = c.source_segment_id WHERE s.document_id IS DISTINCT FROM c.source_document_id AND c.source_document_id <> ''"),
    "claims.accepted_missing_review_metadata": ("error", _fields("okclaims", "claim_id", ACCEPTED_REQUIRED, "status = 'accepted'")),
    "claims.invalid_decision_actor": ("error", "SELECT claim_id AS record, decision_by AS detail FROM okclaims WHERE status = 'accepted' AND decision_by <> '' AND decision_by NOT LIKE 'human:%'"),
    "claims.accepted_without_evidence": ("error", "SELECT claim_id AS record, '' AS detail FROM okclaims WHERE status = 'accepted' AND claim_id NOT IN (SELECT claim_id FROM kevidence WHERE lower(trim(support)) = 'support' AND claim_id IS NOT NULL)"),
    "claims.disputed": ("warning", "SELECT claim_id AS record, '' AS detail FROM okclaims WHERE status = 'disputed'"),
    "evidence.unknown_claim": ("error", _dangling("kevidence", "evidence_id", "claim_id", "claims", "claim_id")),
    "evidence.unknown_document": ("error", _dangling("kevidence", "evidence_id", "source_document_id", "docs", "document_id")),
    "evidence.invalid_segment_id": ("error", "SELECT evidence_id AS record, source_segment_id AS detail FROM kevidence WHERE typeof(source_segment_id) <> 'VARCHAR'"),
    "evidence.unknown_segment": ("error", _dangling("kevidence", "evidence_id", "source_segment_id", "segments", "segment_id")),
    "evidence.segment_document_mismatch": ("error", "SELECT evidence_id AS record, s.document_id AS detail FROM kevidence e JOIN ksegments s ON s.segment_id = e.source_segment_id WHERE s.document_id IS DISTINCT FROM e.source_document_id AND e.source_document_id <> ''"),
    "evidence.invalid_offsets": ("error", "SELECT evidence_id AS record, '' AS detail FROM spans WHERE NOT coalesce(start_char <= end_char, false)"),
    "evidence.out_of_segment_bounds": ("error", "SELECT evidence_id AS record, '' AS detail FROM spans WHERE start_char <= end_char AND (start_char < seg_start OR end_char > seg_end)"),
    "evidence.out_of_document_bounds": ("error", "SELECT evidence_id AS record, '' AS detail FROM spans x JOIN docs d ON d.document_id = x.source_document_id WHERE start_char <= end_char AND end_char > length(d.text)"),
    "derived.missing_field": ("error", _fields("shipped", "edge_id", REQUIRED["derived"])),
    "derived.unknown_source_claim": ("error", _dangling("shipped", "edge_id", "source_claim_id", "claims", "claim_id")),
    "derived.non_accepted_source_claim": ("error", "SELECT edge_id AS record, c.status AS detail FROM shipped e JOIN kclaims c ON c.claim_id = e.source_claim_id WHERE c.status IS DISTINCT FROM 'accepted'"),
    "derived.unknown_predicate": ("error", _dangling("shipped", "edge_id", "predicate", "relations", "key")),
    "derived.unknown_rule": ("error", _dangling("shipped", "edge_id", "rule_key", "rules", "key")),
    "claims.explicit_contradiction": ("warning", "SELECT claim_id AS record, '' AS detail FROM kclaims WHERE status = 'accepted' AND predicate = 'contradicts'"),
    "claims.exclusive_object_conflict": ("warning", """SELECT a.claim_id AS record, b.claim_id AS detail FROM timed a JOIN timed b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.claim_id < b.claim_id
      WHERE a.object_id IS DISTINCT FROM b.object_id AND a.f <= b.t AND b.f <= a.t"""),
}
#: Edges of another making, some of them wrong, beside the derived ones: the checks' table of edges.
SHIPPED = """,
shipped AS (SELECT edge_id, source_claim_id, rule_key, subject_id, predicate, object_id, status, '2000-01-01T00:00:00Z' AS derived_at FROM derived
  UNION ALL SELECT 'edge.old.' || claim_id, CASE WHEN ord % 4 = 0 THEN 'claim.gone' ELSE claim_id END, CASE WHEN ord % 3 = 0 THEN 'old_rule' ELSE 'reverse_dependency' END, subject_id,
  CASE WHEN ord % 5 = 0 THEN 'old_relation' ELSE 'dependency_of' END, CASE WHEN ord % 7 = 0 THEN '' ELSE object_id END, 'derived', NULL FROM claims WHERE ord % 10 = 1 OR ord % 60 = 0),
timed AS (SELECT claim_id, subject_id, predicate, object_id, coalesce(try_cast(valid_from AS TIMESTAMP), TIMESTAMP '0001-01-01') AS f, coalesce(try_cast(valid_to AS TIMESTAMP), TIMESTAMP '9999-12-31 23:59:59') AS t
  FROM kclaims WHERE status = 'accepted' AND predicate IN (SELECT key FROM relations WHERE exclusive_object))
"""


def one_issue(code: str) -> str:
    level, body = ISSUES[code]
    return f"SELECT '{level}' AS level, '{code}' AS code, coalesce(record, '') AS record, coalesce(detail::VARCHAR, '') AS detail FROM ({body})"


def issue_sql(*codes: str) -> str:
    return sql(SHIPPED + " UNION ALL ".join(map(one_issue, codes or ISSUES)))


_CONVERSATION_DOCS = """,
turns AS (SELECT conv_id, turn, repeat('#', (turn % 3 + 1)::INT) || ' ' || coalesce(role, 'none') || chr(10) || chr(10) || coalesce(text, '') AS piece FROM conversations),
cdocs AS (SELECT 'conv.' || conv_id::VARCHAR AS document_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn, piece) AS text FROM turns GROUP BY conv_id),
cl AS (SELECT document_id, string_split(text, chr(10)) AS ls FROM cdocs),
lines AS (SELECT document_id, i AS line, (coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0))::BIGINT AS start_char, ls[i] AS line_text
  FROM (SELECT document_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM cl) WHERE i < len(ls) OR ls[i] <> ''),
heads AS (SELECT document_id, start_char, length(regexp_extract(line_text, '^(#{1,6})\\s+(.*\\S)\\s*$', 1))::BIGINT AS level, regexp_extract(line_text, '^(#{1,6})\\s+(.*\\S)\\s*$', 2) AS title
  FROM lines WHERE regexp_extract(line_text, '^(#{1,6})\\s+(.*\\S)\\s*$', 1) <> ''),
secs AS (SELECT document_id, start_char::BIGINT AS start_char, end_char::BIGINT AS end_char, path FROM (
  SELECT h.document_id, h.start_char, coalesce(lead(h.start_char) OVER (PARTITION BY h.document_id ORDER BY h.start_char), length(d.text)) AS end_char,
    (SELECT string_agg(p.title, ' / ' ORDER BY p.start_char) FROM heads p WHERE p.document_id = h.document_id AND p.start_char <= h.start_char AND (p.start_char = h.start_char OR p.level <
      (SELECT min(q.level) FROM heads q WHERE q.document_id = h.document_id AND q.start_char > p.start_char AND q.start_char <= h.start_char))) AS path
  FROM heads h JOIN cdocs d USING (document_id)
  UNION ALL SELECT d.document_id, 0, coalesce(min(h.start_char), length(any_value(d.text))), '' FROM cdocs d LEFT JOIN heads h USING (document_id) GROUP BY d.document_id)
  WHERE end_char > start_char)
"""
