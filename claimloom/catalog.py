"""The library's registered queries and, beside each, the SQL that it must agree with."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom import oracles
from claimloom.functions import text as fx
from claimloom.operators import dq, graph, lint_text, mirror, report, rules, segment, validate, vectors
from claimloom.plans import star
from claimloom.plans.conversations import conversation_documents
from claimloom.plans.registry import SCHEMA_VERSION, Registry
from claimloom.sources import shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: What traversals start from, and how far they go.
SEED, HOPS = "customer.7", 3
STATUSES = ["active"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with its SQL over the registry's views."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = oracles.sql(sql)
        return f

    return add


def on_registry(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[Registry], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: f(star.registry(spark, sf_dir)))
        return f

    return add


def on_table(name: str, table: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[DataFrame], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet")))
        return f

    return add


def _derived(r: Registry) -> DataFrame:
    return rules.derive(r.claims, r.rules)


def _shipped(r: Registry) -> Registry:
    """The derived edges beside older ones, some of them wrong, for the checks."""
    made = _derived(r).select("edge_id", "source_claim_id", "rule_key", "subject_id", "predicate", "object_id", "status", F.lit("2000-01-01T00:00:00Z").alias("derived_at"))
    old = r.claims.filter("ord % 10 = 1 or ord % 60 = 0").select(
        F.concat(F.lit("edge.old."), "claim_id").alias("edge_id"), F.when(F.col("ord") % 4 == 0, "claim.gone").otherwise(F.col("claim_id")).alias("source_claim_id"),
        F.when(F.col("ord") % 3 == 0, "old_rule").otherwise("reverse_dependency").alias("rule_key"), "subject_id",
        F.when(F.col("ord") % 5 == 0, "old_relation").otherwise("dependency_of").alias("predicate"), F.when(F.col("ord") % 7 == 0, "").otherwise(F.col("object_id")).alias("object_id"),
        F.lit("derived").alias("status"), F.lit(None).cast("string").alias("derived_at"),
    )
    return r.with_derived(made.unionByName(old))


# --- sources, filters, expressions ---


@on_registry("src_registry_scan", " UNION ALL ".join(f"SELECT '{n}' AS registry, count(*)::BIGINT AS n FROM {t}" for n, t in (("entities", "entities"), ("documents", "docs"), ("claims", "claims"), ("evidence", "evidence"), ("segments", "segments"))))
def _(r: Registry) -> DataFrame:
    parts = [getattr(r, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("registry"), "n") for n in ("entities", "documents", "claims", "evidence", "segments")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@on_registry("src_documents_text", "SELECT document_id, length(text)::BIGINT AS n_chars, sha256(text) AS text_hash FROM docs")
def _(r: Registry) -> DataFrame:
    return r.documents.select("document_id", F.length("text").cast("long").alias("n_chars"), fx.text_hash(F.col("text")).alias("text_hash"))


@on_registry("flt_text_suffix", "SELECT document_id, path FROM docs WHERE lower(regexp_extract(path, '\\.[^./]+$')) IN ('.md', '.markdown', '.txt', '.rst')")
def _(r: Registry) -> DataFrame:
    return segment.text_documents(r.documents).select("document_id", "path")


@on_registry("flt_accepted_claims", "SELECT claim_id, predicate FROM claims WHERE status = 'accepted'")
def _(r: Registry) -> DataFrame:
    return r.claims.filter("status = 'accepted'").select("claim_id", "predicate")


@on_registry("flt_segment_status", "SELECT segment_id, text FROM segments WHERE status IN ('active')")
def _(r: Registry) -> DataFrame:
    return vectors.index_rows(r.segments, STATUSES).select("segment_id", "text")


@on_table("exp_text_hash", "documents", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(d: DataFrame) -> DataFrame:
    return d.select("doc_id", fx.text_hash(F.col("text")).alias("h"))


@on_table("exp_slugify", "part", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM part")
def _(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", fx.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


@on_table("exp_normalize_key", "part", "SELECT p_partkey, translate(lower(trim('  ' || p_type || '-X ')), ' -', '__') AS k FROM part")
def _(d: DataFrame) -> DataFrame:
    return d.select("p_partkey", fx.key_form(F.concat(F.lit("  "), "p_type", F.lit("-X "))).alias("k"))


@on_registry("exp_meta_roundtrip", "SELECT entity_id, len(aliases)::BIGINT AS n, aliases[1] AS first FROM entities")
def _(r: Registry) -> DataFrame:
    back = fx.decode_list(fx.encode_value(F.col("aliases")))
    return r.entities.select("entity_id", F.size(back).cast("long").alias("n"), F.get(back, 0).alias("first"))


@on_registry("exp_parse_ts", "SELECT claim_id, epoch(try_cast(valid_from AS TIMESTAMP))::BIGINT AS f, epoch(try_cast(valid_to AS TIMESTAMP))::BIGINT AS t FROM claims")
def _(r: Registry) -> DataFrame:
    return r.claims.select("claim_id", *(F.unix_timestamp(fx.moment(F.col(c))).alias(k) for c, k in (("valid_from", "f"), ("valid_to", "t"))))


@on_table("exp_tokens", "documents", "SELECT doc_id, len(t)::BIGINT AS n, sha256(array_to_string(t, ' ')) AS whole FROM (SELECT doc_id, CASE WHEN len(x) > 0 THEN x ELSE ['__empty__'] END AS t FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS x FROM documents))")
def _(d: DataFrame) -> DataFrame:
    t = d.select("doc_id", fx.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), fx.text_hash(F.array_join("t", " ")).alias("whole"))


# --- keys, grouping ---


@on_registry("agg_evidence_by_claim", "SELECT claim_id, count(*)::BIGINT AS n, count(*) FILTER (lower(trim(support)) = 'support')::BIGINT AS supporting FROM evidence GROUP BY claim_id")
def _(r: Registry) -> DataFrame:
    return r.evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(fx.match_form(F.col("support")) == "support").alias("supporting"))


@on_registry("dq_keyed_first", "SELECT evidence_id, ord FROM kevidence")
def _(r: Registry) -> DataFrame:
    return dq.first_by_key(r.evidence, "evidence_id", ["ord"]).select("evidence_id", "ord")


@on_registry("dq_keyed_last", "SELECT evidence_id, max(ord) AS ord FROM evidence GROUP BY evidence_id")
def _(r: Registry) -> DataFrame:
    return dq.last_by_key(r.evidence, "evidence_id", ["ord"]).select("evidence_id", "ord")


@on_registry("dq_duplicate_keys", "SELECT evidence_id, (count(*) - 1)::BIGINT AS extra FROM evidence WHERE evidence_id <> '' GROUP BY evidence_id HAVING count(*) > 1")
def _(r: Registry) -> DataFrame:
    return dq.duplicate_keys(r.evidence, "evidence_id")


@on_registry("dq_missing_keys", "SELECT claim_id, ord FROM evidence WHERE coalesce(evidence_id, '') = ''")
def _(r: Registry) -> DataFrame:
    return dq.missing_keys(r.evidence, "evidence_id").select("claim_id", "ord")


# --- rules ---


@on_registry("der_edges", "SELECT edge_id, source_claim_id, rule_key, subject_id, predicate, object_id, status, confidence, valid_from, valid_to FROM derived")
def _(r: Registry) -> DataFrame:
    return _derived(r)


@on_registry("der_summary", "SELECT rule_key, count(*)::BIGINT AS n FROM derived GROUP BY rule_key")
def _(r: Registry) -> DataFrame:
    return _derived(r).groupBy("rule_key").agg(F.count(F.lit(1)).alias("n"))


@on_table("der_unknown_predicate", "part", "SELECT 'part.' || p_partkey AS key, p_type AS derive_predicate FROM part WHERE p_partkey % 5 <> 0 AND p_type NOT IN (SELECT p_type FROM part WHERE p_size = 1)")
def _(d: DataFrame) -> DataFrame:
    """Rules that parts stand for, each deriving its part's type; declared are the types of parts of size 1."""
    made = d.select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("derive_predicate"), (F.col("p_partkey") % 5 != 0).alias("materialize"))
    return rules.unknown_predicates(made, d.filter("p_size = 1").select(F.col("p_type").alias("key")).distinct()).select("key", "derive_predicate")


# --- projection ---

_NODES = " UNION ALL ".join(f"SELECT '{f}' AS family, '{k}:' || {key} AS node_id, '{t}' AS node_type, {key} AS source_id FROM {'docs' if source == 'documents' else source} WHERE trim(coalesce({key}, '')) <> ''" for f, (source, key, k, t) in graph.NODE_FAMILIES.items())
_MENTIONS = "(SELECT segment_id, unnest(entity_ids) AS entity_id FROM segments)"
_PREDICATES = "SELECT 'claim_predicates' AS family, 'edge.claim_predicate.' || claim_id AS edge_id, predicate AS edge_type, 'entity:' || subject_id AS from_id, 'entity:' || object_id AS to_id FROM claims WHERE status = 'accepted' AND predicate <> '' AND subject_id <> '' AND object_id <> ''"
_EDGES = (
    _PREDICATES
    + " UNION ALL SELECT 'segment_documents', 'edge.segment_document.' || segment_id || '.' || document_id, 'SEGMENT_DOCUMENT', 'segment:' || segment_id, 'document:' || document_id FROM segments WHERE document_id <> ''"
    + " UNION ALL SELECT 'claim_segments', 'edge.claim_segment.' || claim_id || '.' || source_segment_id, 'CLAIM_SEGMENT', 'claim:' || claim_id, 'segment:' || source_segment_id FROM claims WHERE source_segment_id <> ''"
    + " UNION ALL SELECT 'claim_evidence', 'edge.claim_evidence.' || claim_id || '.' || evidence_id, 'HAS_EVIDENCE', 'claim:' || claim_id, 'evidence:' || evidence_id FROM evidence WHERE evidence_id <> '' AND claim_id <> ''"
    + " UNION ALL SELECT 'evidence_segments', 'edge.evidence_segment.' || evidence_id || '.' || source_segment_id, 'EVIDENCE_SEGMENT', 'evidence:' || evidence_id, 'segment:' || source_segment_id FROM evidence WHERE evidence_id <> '' AND source_segment_id <> ''"
    + f" UNION ALL SELECT 'segment_mentions', 'edge.segment_mentions.' || segment_id || '.' || entity_id, 'MENTIONS', 'segment:' || segment_id, 'entity:' || entity_id FROM {_MENTIONS}"
    + " UNION ALL SELECT 'derived_relations', 'edge.derived.' || edge_id, predicate, 'entity:' || subject_id, 'entity:' || object_id FROM derived WHERE predicate <> '' AND subject_id <> '' AND object_id <> ''"
)


@on_registry("prj_nodes", _NODES)
def _(r: Registry) -> DataFrame:
    return graph.nodes(r).drop("payload")


@on_registry("prj_edges", _EDGES)
def _(r: Registry) -> DataFrame:
    return graph.edges(r.with_derived(_derived(r))).drop("payload")


@on_registry("prj_claim_predicates", _PREDICATES.replace("status = 'accepted' AND ", ""))
def _(r: Registry) -> DataFrame:
    return graph.claim_predicates(r, include_nonaccepted=True).drop("payload")


_FAMILIES = ", ".join(f"('{f}')" for f in [*graph.NODE_FAMILIES, *graph.EDGE_FAMILIES])


@on_registry("prj_summary", f"SELECT f.family, count(x.family)::BIGINT AS n FROM (VALUES {_FAMILIES}) f(family) LEFT JOIN (SELECT family FROM ({_NODES}) UNION ALL SELECT family FROM ({_EDGES})) x ON x.family = f.family GROUP BY f.family")
def _(r: Registry) -> DataFrame:
    return graph.summary(r.with_derived(_derived(r)))


# --- mirror ---

_VIEW_OF = {"documents": "docs", "claim_evidence": "evidence", "derived_edges": "derived"}
#: Of each mirror table the names of the row's fields in the payload, and some of its texts.
_PAYLOAD = {
    "relations": ["label"], "document_types": ["default_claim_status"], "entities": ["label", "status"], "documents": ["title", "text", "path"], "claims": ["object_type", "asserted_by", "valid_to", "decision_by", "source_segment_id"],
    "claim_evidence": ["excerpt", "captured_by", "source_segment_id"], "segments": ["text", "text_hash", "segmenter_version"], "derived_edges": ["valid_from", "valid_to", "predicate"],
}
_ABSENT = {("relations", "group_name"), ("document_types", "label")}


def _mirror_sql(name: str) -> str:
    typed = ", ".join("'' AS " + c if (name, c) in _ABSENT else f"{mirror.SOURCES.get(c, c)} AS {c}" if c == "ordinal" else f"coalesce({mirror.SOURCES.get(c, c)}::VARCHAR, '') AS {c}" for c in mirror.COLUMNS[name])
    return f"SELECT {typed}, sha256(concat_ws('|', {', '.join(f'coalesce({c}, chr(126))' for c in _PAYLOAD[name])})) AS payload FROM {_VIEW_OF.get(name, 'made_' * (name in _MANIFESTS) + name)}"


#: Manifests that parts and orders stand for: relations and document types of any number.
_MANIFESTS = {
    "relations": "SELECT 'relation.' || cast(p_partkey AS string) AS key, CASE WHEN p_size % 7 <> 0 THEN p_name END AS label, p_size = 1 AS exclusive_object FROM {part}",
    "document_types": "SELECT 'type.' || cast(o_orderkey AS string) AS key, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'accepted' ELSE 'proposed' END AS default_claim_status FROM {orders}",
}


def _with_manifests(r: Registry, sf_dir: str) -> Registry:
    spark = r.claims.sparkSession
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders")}
    return replace(r, **{n: spark.sql(sql, **{t: f for t, f in tables.items() if f"{{{t}}}" in sql}) for n, sql in _MANIFESTS.items()})


_OVER_MANIFESTS = ", made_relations AS (" + _MANIFESTS["relations"].format(part="part") + "), made_document_types AS (" + _MANIFESTS["document_types"].format(orders="orders") + ") "

for _name in mirror.COLUMNS:

    @query(f"mir_{_name}", _OVER_MANIFESTS + _mirror_sql(_name) if _name in _MANIFESTS else _mirror_sql(_name))
    def _(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        r = star.registry(spark, sf_dir)
        r = _with_manifests(r, sf_dir) if name in _MANIFESTS else r
        texts = [F.coalesce(F.get_json_object("payload_json", f"$.{c}"), F.lit("~")) for c in _PAYLOAD[name]]
        return mirror.mirror_table(r.with_derived(_derived(r)), name).select(*mirror.COLUMNS[name], fx.text_hash(F.concat_ws("|", *texts)).alias("payload"))


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS source_path, count(*)::BIGINT AS row_count FROM {_VIEW_OF.get(n, n)}" for n in mirror.COLUMNS)


@on_registry("mir_meta_counts", f"SELECT *, '{SCHEMA_VERSION}' AS schema_version FROM ({_COUNTS})")
def _(r: Registry) -> DataFrame:
    return mirror.counts(r.with_derived(_derived(r)))


@on_registry("val_mirror_freshness", f"SELECT 'warning' AS level, 'mirror.stale' AS code, source_path AS record, '' AS detail FROM ({_COUNTS}) WHERE row_count % 2 = 0 OR source_path = 'entities'")
def _(r: Registry) -> DataFrame:
    # A ledger in which the even counts are out of date and one table's row is missing.
    sources = mirror.counts(r.with_derived(_derived(r))).withColumn("source_hash", F.lit(None).cast("string"))
    ledger = sources.filter("source_path <> 'entities'").withColumn("row_count", F.when(F.col("row_count") % 2 == 0, F.col("row_count") + 1).otherwise(F.col("row_count")))
    return validate.mirror_issues(ledger, sources)


@on_registry("mir_sync", f"SELECT source_path, row_count, row_count AS rows_written, '{SCHEMA_VERSION}' AS schema_version FROM ({_COUNTS})")
def _(r: Registry) -> DataFrame:
    spark = r.claims.sparkSession
    ledger = mirror.sync(r.with_derived(_derived(r)), shared.scratch_path(spark, "mirror"))
    there = [spark.read.parquet(x.location).agg(F.count(F.lit(1)).alias("rows_written")).withColumn("source_path", F.lit(x.source_path)) for x in ledger.select("source_path", "location").collect()]
    return ledger.join(reduce(DataFrame.unionByName, there), "source_path").select("source_path", "row_count", "rows_written", "schema_version")


# --- segments ---


def _markdown(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(conversation_documents(spark, sf_dir))


def _sections(d: DataFrame) -> DataFrame:
    return segment.sections(d).select("document_id", "start_char", "end_char", F.array_join("heading_path", " / ").alias("path"))


_CONV = oracles._CONVERSATION_DOCS
query("seg_line_offsets", _CONV + "SELECT document_id, line, start_char, line_text FROM lines")(_markdown(segment.lines))
query("seg_headings", _CONV + "SELECT document_id, start_char, level, title FROM heads")(_markdown(segment.headings))
query("seg_sections", _CONV + "SELECT document_id, start_char, end_char, path FROM secs")(_markdown(_sections))
query(
    "seg_paragraphs",
    _CONV + r""", pp AS (SELECT document_id, text, string_split_regex(text, '\n\s*\n') AS ps, regexp_extract_all(text, '\n\s*\n') AS gs FROM cdocs)
    SELECT document_id, s AS start_char, s + length(p) AS end_char FROM (SELECT document_id, ps[i] AS p,
      (coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gs[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pp)) WHERE regexp_matches(p, '\S')""",
)(_markdown(segment.paragraphs))


def _underlined(d: DataFrame) -> DataFrame:
    """Conversations with underlined titles in place of marked ones."""
    under = F.regexp_replace(F.regexp_replace("text", "(?m)^# (.*)$", "$1\n=========="), "(?m)^##+ (.*)$", "$1\n----------")
    return segment.underlined_headings(d.withColumn("text", under))


query(
    "seg_rst_headings",
    _CONV + """, ud AS (SELECT document_id, regexp_replace(regexp_replace(text, '(?m)^# (.*)$', '\\1' || chr(10) || '==========', 'g'), '(?m)^##+ (.*)$', '\\1' || chr(10) || '----------', 'g') AS text FROM cdocs),
    ul AS (SELECT document_id, string_split(text, chr(10)) AS ls FROM ud),
    ux AS (SELECT document_id, i, ls[i] AS l, ls[i + 1] AS nx, coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0)::BIGINT AS start_char FROM (SELECT *, unnest(range(1, len(ls))) AS i FROM ul))
    SELECT document_id, start_char, CASE nx[1] WHEN '=' THEN 1 ELSE 2 END::BIGINT AS level, trim(l) AS title FROM ux WHERE trim(l) <> '' AND regexp_matches(nx, '^(=+|-+)$') AND length(nx) >= length(trim(l))""",
)(_markdown(_underlined))


@on_registry("seg_sliding", "SELECT segment_id, ordinal, start_char, length(text)::BIGINT AS n_chars FROM segments")
def _(r: Registry) -> DataFrame:
    return r.segments.select("segment_id", "ordinal", "start_char", F.length("text").cast("long").alias("n_chars"))


query(
    "seg_build",
    _CONV + r""", sx AS (SELECT document_id, start_char AS sec, substr(c.text, start_char + 1, end_char - start_char) AS body, text FROM secs JOIN cdocs c USING (document_id)),
    px AS (SELECT document_id, sec, string_split_regex(body, '\n\s*\n') AS ps, regexp_extract_all(body, '\n\s*\n') AS gs FROM sx),
    sp AS (SELECT document_id, sec, row_number() OVER (PARTITION BY document_id, sec ORDER BY i) AS k, sec + s AS a, sec + s + length(p) AS b FROM (SELECT document_id, sec, i, ps[i] AS p,
      (coalesce(list_sum(list_transform(ps[1:i-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(gs[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM px)) WHERE regexp_matches(p, '\S')),
    fold AS (WITH RECURSIVE f AS (SELECT document_id, sec, k, a AS cs, b AS ce, a AS pa, 1 AS g FROM sp WHERE k = 1
      UNION ALL SELECT n.document_id, n.sec, n.k, CASE WHEN n.b - f.cs <= 1200 AND f.ce - f.cs <= 1200 THEN f.cs ELSE n.a END, n.b, n.a, CASE WHEN n.b - f.cs <= 1200 AND f.ce - f.cs <= 1200 THEN f.g ELSE f.g + 1 END
      FROM f JOIN sp n ON n.document_id = f.document_id AND n.sec = f.sec AND n.k = f.k + 1) SELECT * FROM f),
    packs AS (SELECT document_id, sec, g, min(cs) AS a, max(ce) AS b FROM fold GROUP BY ALL),
    slid AS (SELECT document_id, sec, g, a + o * 1050 AS a, least(a + o * 1050 + 1200, b) AS b FROM (SELECT *, unnest(range(0, 1 + CASE WHEN b - a > 1200 THEN ceil((b - a - 1200)::DOUBLE / 1050)::BIGINT ELSE 0 END)) AS o FROM packs)),
    good AS (SELECT s.*, substr(c.text, (s.a + 1)::BIGINT, (s.b - s.a)::BIGINT) AS body FROM slid s JOIN cdocs c USING (document_id))
    SELECT g.document_id, row_number() OVER (PARTITION BY g.document_id ORDER BY a) AS ordinal, a::BIGINT AS start_char, b::BIGINT AS end_char, sha256(body) AS text_hash,
      array_to_string(list_sort(list_distinct(['conversation'] || list_transform(list_filter(string_split(p.path, ' / '), lambda x: x <> ''), lambda x: coalesce(nullif(trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled')))), ',') AS tags
    FROM good g JOIN secs p ON p.document_id = g.document_id AND p.start_char = g.sec WHERE regexp_matches(body, '\S')""",
)(_markdown(lambda d: segment.build(d).select("document_id", "ordinal", "start_char", "end_char", "text_hash", F.array_join("tags", ",").alias("tags"))))


@on_registry("seg_coverage", "SELECT CASE WHEN text IS NULL THEN 'missing' WHEN lower(regexp_extract(path, '\\.[^./]+$')) IN ('.md', '.markdown', '.txt', '.rst') THEN 'segmented' ELSE 'unsupported' END AS kind, count(*)::BIGINT AS n FROM docs GROUP BY 1")
def _(r: Registry) -> DataFrame:
    return segment.coverage(r.documents)


@on_registry(
    "seg_links",
    """, both_ AS (SELECT source_segment_id AS segment_id, claim_id, subject_id, object_id FROM claims UNION ALL SELECT e.source_segment_id, e.claim_id, c.subject_id, c.object_id FROM evidence e LEFT JOIN claims c USING (claim_id)),
    ends AS (SELECT segment_id, subject_id AS e FROM both_ UNION ALL SELECT segment_id, object_id FROM both_)
    SELECT b.segment_id, b.claims, coalesce(e.ents, '') AS entities FROM (SELECT segment_id, string_agg(DISTINCT claim_id, ',' ORDER BY claim_id) AS claims FROM both_ WHERE segment_id <> '' AND claim_id IS NOT NULL GROUP BY 1) b
    LEFT JOIN (SELECT segment_id, string_agg(DISTINCT e, ',' ORDER BY e) AS ents FROM ends WHERE e <> '' GROUP BY 1) e ON e.segment_id = b.segment_id""",
)
def _(r: Registry) -> DataFrame:
    return segment.links(r.claims, r.evidence).select("segment_id", F.array_join("claim_ids", ",").alias("claims"), F.array_join("entity_ids", ",").alias("entities"))


# --- traversal ---

_ADJACENCY = f""", conn AS (
  SELECT 'entity:' || subject_id AS a, 'claim:' || claim_id AS b FROM claims WHERE status = 'accepted' UNION ALL SELECT 'claim:' || claim_id, 'entity:' || object_id FROM claims WHERE status = 'accepted'
  UNION ALL SELECT 'claim:' || claim_id, 'segment:' || source_segment_id FROM claims WHERE status = 'accepted' AND source_segment_id <> ''
  UNION ALL SELECT 'claim:' || claim_id, 'evidence:' || evidence_id FROM evidence WHERE evidence_id <> '' UNION ALL SELECT 'evidence:' || evidence_id, 'segment:' || source_segment_id FROM evidence WHERE evidence_id <> '' AND source_segment_id <> ''
  UNION ALL SELECT 'segment:' || segment_id, 'document:' || document_id FROM segments UNION ALL SELECT 'segment:' || segment_id, 'entity:' || entity_id FROM {_MENTIONS}
  UNION ALL SELECT 'entity:' || subject_id, 'entity:' || object_id FROM derived),
adj AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM conn UNION ALL SELECT b, a FROM conn))"""
_SEEDS = f""", seeds AS (SELECT DISTINCT entity_id FROM entities WHERE lower(entity_id) = '{SEED}' OR lower(label) = '{SEED}' OR list_contains(list_transform(aliases, lambda x: lower(x)), '{SEED}')
  OR contains(lower(entity_id), '{SEED}') OR contains(lower(label), '{SEED}') OR len(list_filter(aliases, lambda x: contains(lower(x), '{SEED}'))) > 0)"""


def _hops(n: int) -> str:
    out = ", h0 AS (SELECT 'entity:' || entity_id AS node_id, 0 AS depth, 'entity:' || entity_id AS route FROM seeds), v0 AS (SELECT * FROM h0)"
    for d in range(1, n + 1):
        out += f", h{d} AS (SELECT a.b AS node_id, {d} AS depth, arg_min(h.route, h.node_id) || ' -> ' || a.b AS route FROM h{d - 1} h JOIN adj a ON a.a = h.node_id WHERE a.b NOT IN (SELECT node_id FROM v{d - 1}) GROUP BY a.b), v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT * FROM h{d})"
    return out + f", walked AS (SELECT * FROM v{n})"


_WALK = _ADJACENCY + _SEEDS + _hops(HOPS)
_KINDS = f"SELECT DISTINCT node_id, node_type AS kind FROM ({_NODES})"
_DIRECT = """, mine AS (SELECT * FROM claims WHERE status = 'accepted' AND (subject_id IN (SELECT entity_id FROM seeds) OR object_id IN (SELECT entity_id FROM seeds))),
shown AS (SELECT * FROM evidence WHERE claim_id IN (SELECT claim_id FROM mine)),
direct AS (SELECT DISTINCT kind, id FROM (SELECT 'entities' AS kind, entity_id AS id FROM seeds UNION ALL SELECT 'entities', subject_id FROM mine UNION ALL SELECT 'entities', object_id FROM mine UNION ALL SELECT 'claims', claim_id FROM mine
  UNION ALL SELECT 'segments', source_segment_id FROM mine UNION ALL SELECT 'segments', source_segment_id FROM shown UNION ALL SELECT 'documents', source_document_id FROM mine UNION ALL SELECT 'documents', source_document_id FROM shown) WHERE id <> ''
  UNION ALL SELECT 'evidence', coalesce(evidence_id, '') FROM shown)"""


@on_registry("gr_seed_match", _SEEDS + " SELECT entity_id FROM seeds")
def _(r: Registry) -> DataFrame:
    return graph.seeds(r, SEED)


@on_registry("gr_baseline", _SEEDS + _DIRECT.replace("SELECT DISTINCT kind, id FROM (", "SELECT DISTINCT * FROM (SELECT kind, id FROM (", 1).replace("WHERE id <> ''\n  UNION ALL", "WHERE id <> '') UNION ALL") + " SELECT kind, id FROM direct")
def _(r: Registry) -> DataFrame:
    return graph.baseline(r, graph.seeds(r, SEED))


@on_registry("gr_adjacency", _ADJACENCY + " SELECT a, b FROM adj")
def _(r: Registry) -> DataFrame:
    return graph.adjacency(r.with_derived(_derived(r)))


def _walk(r: Registry) -> DataFrame:
    r = r.with_derived(_derived(r))
    return graph.bfs(graph.adjacency(r), graph.seeds(r, SEED), HOPS)


@on_registry("gr_bfs", _WALK + " SELECT node_id, depth, route FROM walked")
def _(r: Registry) -> DataFrame:
    return _walk(r).select("node_id", "depth", F.array_join("path", " -> ").alias("route"))


@on_registry("gr_bfs_counts", _WALK + f" SELECT coalesce(k.kind, 'Unknown') AS kind, count(*)::BIGINT AS n FROM walked w LEFT JOIN ({_KINDS}) k USING (node_id) GROUP BY 1")
def _(r: Registry) -> DataFrame:
    return graph.reached(r, _walk(r))


@on_registry("gr_reached_ids", _WALK + f" SELECT coalesce(k.kind, 'Unknown') AS kind, regexp_replace(w.node_id, '^[^:]*:', '') AS id FROM walked w LEFT JOIN ({_KINDS}) k USING (node_id)")
def _(r: Registry) -> DataFrame:
    return graph.reached_ids(r, _walk(r))


@on_registry("gr_sample_paths", _WALK + " SELECT node_id, route FROM walked WHERE depth > 0 ORDER BY node_id LIMIT 6")
def _(r: Registry) -> DataFrame:
    return graph.sample_paths(_walk(r))


@on_registry(
    "gr_uplift",
    _WALK + _DIRECT + f""" SELECT f.measure, coalesce(d.n, 0)::BIGINT AS direct, coalesce(g.n, 0)::BIGINT AS graph, (coalesce(g.n, 0) - coalesce(d.n, 0))::BIGINT AS more
    FROM (VALUES ('entities', 'Entity'), ('documents', 'Document'), ('segments', 'Segment'), ('claims', 'Claim'), ('evidence', 'Evidence')) f(measure, kind)
    LEFT JOIN (SELECT kind AS measure, count(*) AS n FROM direct GROUP BY 1) d ON d.measure = f.measure
    LEFT JOIN (SELECT k.kind, count(*) AS n FROM walked JOIN ({_KINDS}) k USING (node_id) GROUP BY 1) g ON g.kind = f.kind""",
)
def _(r: Registry) -> DataFrame:
    return graph.uplift(r.with_derived(_derived(r)), SEED, HOPS)


# --- vectors ---

_SPARSE = """SELECT doc_id, place, sum(n * sign)::BIGINT AS weight FROM (SELECT doc_id, n, ('0x' || substr(h, (4 * i + 1)::INT, 2))::BIGINT % 256 AS place, CASE WHEN ('0x' || substr(h, (4 * i + 3)::INT, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT doc_id, n, sha256(token) AS h, unnest(range(0, 16)) AS i FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['__empty__'] END) AS token
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS x FROM documents)) GROUP BY ALL))) GROUP BY ALL HAVING sum(n * sign) <> 0"""


@on_table("emb_hash_sparse", "documents", _SPARSE)
def _(d: DataFrame) -> DataFrame:
    return vectors.sparse(d, "doc_id")


@on_table("emb_hash", "documents", f", sp_ AS ({_SPARSE}) SELECT d.doc_id, 256::BIGINT AS dims, round(coalesce(x.a, 0), 6) AS by_place, round(coalesce(x.b, 0), 6) AS absolute, coalesce(x.c, 0)::BIGINT AS places FROM documents d LEFT JOIN (SELECT doc_id, sum(weight * (place + 1)) / sqrt(sum(weight * weight)) AS a, sum(abs(weight)) / sqrt(sum(weight * weight)) AS b, count(*) AS c FROM sp_ GROUP BY doc_id) x USING (doc_id)")
def _(d: DataFrame) -> DataFrame:
    e = vectors.embed(d, "doc_id")
    total = lambda f: F.round(F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda s, x: s + x), 6)
    places = F.size(F.filter("embedding", lambda x: x != 0)).cast("long")
    return e.select("doc_id", F.size("embedding").cast("long").alias("dims"), total(lambda x, i: x * (i + 1)).alias("by_place"), total(lambda x: F.abs(x)).alias("absolute"), places.alias("places"))


def _probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    index = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return index, list(index.filter("vec_id = 0").first().embedding)


_NEAR = "SELECT vec_id, label, round(1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS distance FROM embeddings"


@query("ret_topk", _NEAR + " ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 8")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, probe = _probe(spark, sf_dir)
    return vectors.top_k(index, probe, "vec_id").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("ret_topk_filtered", _NEAR + " WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 8")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, probe = _probe(spark, sf_dir)
    return vectors.top_k(index, probe, "vec_id", where={"label": 3}).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _old_index(r: Registry) -> DataFrame:
    """An index made when there were other segments."""
    gone = r.documents.select(F.concat(F.lit("seg:"), "document_id", F.lit(":gone")).alias("segment_id"))
    return r.segments.filter("ordinal % 2 = 1").select("segment_id").unionByName(gone)


_OLD = ", old_ AS (SELECT segment_id FROM segments WHERE ordinal % 2 = 1 UNION ALL SELECT 'seg:' || document_id || ':gone' FROM docs), cur_ AS (SELECT DISTINCT segment_id FROM segments WHERE status IN ('active'))"


@on_registry("ret_index_sync", _OLD + " SELECT segment_id, 'upsert' AS action FROM cur_ UNION ALL SELECT DISTINCT segment_id, 'delete' FROM old_ WHERE segment_id NOT IN (SELECT segment_id FROM cur_)")
def _(r: Registry) -> DataFrame:
    return vectors.sync_plan(r.segments, _old_index(r), STATUSES)


@on_registry("ret_stale_ids", _OLD + " SELECT DISTINCT segment_id FROM old_ WHERE segment_id NOT IN (SELECT segment_id FROM cur_)")
def _(r: Registry) -> DataFrame:
    return vectors.stale(_old_index(r), vectors.index_rows(r.segments, STATUSES))


# --- validation ---

for _code in validate.CODES:
    QUERIES["val_" + _code.replace(".", "_")] = lambda spark, sf_dir, code=_code: validate.issues(_shipped(star.registry(spark, sf_dir)), [code])
    ORACLES["val_" + _code.replace(".", "_")] = oracles.issue_sql(_code)


@query(
    "val_document_types_invalid_default_claim_status",
    _OVER_MANIFESTS + "SELECT 'error' AS level, 'document_types.invalid_default_claim_status' AS code, key AS record, coalesce(default_claim_status, '') AS detail FROM made_document_types WHERE default_claim_status IS DISTINCT FROM 'proposed'",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.issues(_with_manifests(star.registry(spark, sf_dir), sf_dir), ["document_types.invalid_default_claim_status"])


@on_registry("val_issues", oracles.SHIPPED + "SELECT level, code, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(map(oracles.one_issue, oracles.ISSUES)) + ") GROUP BY ALL")
def _(r: Registry) -> DataFrame:
    return validate.issues(_shipped(r)).groupBy("level", "code").agg(F.count(F.lit(1)).alias("n"))


@on_registry("val_summary", oracles.SHIPPED + "SELECT (count(*) FILTER (level = 'error'))::BIGINT AS errors, (count(*) FILTER (level = 'warning'))::BIGINT AS warnings, CASE WHEN count(*) FILTER (level = 'error') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM (" + " UNION ALL ".join(map(oracles.one_issue, oracles.ISSUES)) + ")")
def _(r: Registry) -> DataFrame:
    return validate.summary(validate.issues(_shipped(r)))


_WARNED = [c for c in validate.CODES if oracles.ISSUES[c][0] == "warning"]


@on_registry("val_summary_warnings", oracles.SHIPPED + "SELECT (count(*) FILTER (level = 'error'))::BIGINT AS errors, (count(*) FILTER (level = 'warning'))::BIGINT AS warnings, CASE WHEN count(*) FILTER (level = 'error') > 0 THEN 'failed' WHEN count(*) > 0 THEN 'passed_with_warnings' ELSE 'passed' END AS status FROM (" + " UNION ALL ".join(map(oracles.one_issue, _WARNED)) + ")")
def _(r: Registry) -> DataFrame:
    return validate.summary(validate.issues(_shipped(r), _WARNED))


@on_registry("rep_status", oracles.SHIPPED + "SELECT count(*)::BIGINT AS findings, (count(*) FILTER (level = 'error') > 0)::INT AS exit_status FROM (" + " UNION ALL ".join(map(oracles.one_issue, oracles.ISSUES)) + ")")
def _(r: Registry) -> DataFrame:
    text, status = report.rendered(validate.issues(_shipped(r)), "star", as_json=True, shown=5)
    total = json.loads(text)["summary"]
    return r.claims.sparkSession.createDataFrame([(total["errors"] + total["warnings"], status)], "findings long, exit_status int")


# --- text scans ---


@on_table("lint_md_refs", "pages", """SELECT page_id, unnest(list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), 'href="?([^" >]+)', 1)))) AS reference FROM pages""")
def _(d: DataFrame) -> DataFrame:
    marked = d.select("page_id", F.regexp_replace("html", 'href="?([^" >]+)', "`$1`").alias("text"))
    return marked.select("page_id", F.explode(lint_text.quoted(F.col("text"))).alias("reference"))


@on_table("lint_doc_metadata", "conversations", r"""SELECT doc, name, arg_min(value, pos) AS value FROM (SELECT doc, pos, translate(lower(trim(regexp_extract(l, '^([A-Za-z][A-Za-z _-]*): (\S.*?)\s*$', 1))), ' -', '__') AS name, regexp_extract(l, '^([A-Za-z][A-Za-z _-]*): (\S.*?)\s*$', 2) AS value
  FROM (SELECT conv_id::VARCHAR || '.' || turn::VARCHAR AS doc, 1 AS pos, 'Owner Role: ' || role AS l FROM conversations UNION ALL SELECT conv_id::VARCHAR || '.' || turn::VARCHAR, 2, 'turn: ' || turn::VARCHAR FROM conversations)) WHERE name <> '' GROUP BY ALL""")
def _(d: DataFrame) -> DataFrame:
    doc = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    made = d.select(doc.alias("doc"), F.concat(F.lit("- Owner Role: "), "role", F.lit("\n- turn: "), F.col("turn").cast("string")).alias("text"))
    return lint_text.metadata(made, "doc")


from claimloom import catalog_files  # noqa: E402, F401  the queries over files register themselves
