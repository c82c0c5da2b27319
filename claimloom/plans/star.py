"""A provenance registry laid over the star-schema tables, so that every operator runs on them.

The views are written once, as SQL that two engines read; the few spellings in which they differ
come from a Dialect. Anomalies (unknown objects, unsupported claims, bad states) are built in, so
that checks have something to find.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import segment
from claimloom.plans.registry import Registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "labels")


@dataclass(frozen=True)
class Dialect:
    array: str
    iso: str

    def list(self, *items: str) -> str:
        return self.array.format(", ".join(items))

    def utc(self, x: str) -> str:
        return self.iso.format(x)


SPARK = Dialect("array({})", "date_format({}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
DUCKDB = Dialect("[{}]", "strftime({}, '%Y-%m-%dT%H:%M:%SZ')")


def views(d: Dialect) -> dict[str, str]:
    """name -> SELECT, in an order in which each reads tables and earlier views only."""
    document = "'doc.' || cast({} % (SELECT count(*) FROM documents) AS string)"
    return {
        "relations": """SELECT * FROM (VALUES
            ('depends_on', 'depends on', false, true), ('implemented_by', 'implemented by', false, true), ('supports', 'supports', false, true),
            ('contradicts', 'contradicts', false, false), ('classifies_as', 'classifies as', true, true), ('dependency_of', 'dependency of', false, true)
            ) AS t(key, label, exclusive_object, evidence_required)""",
        "rules": """SELECT * FROM (VALUES
            ('reverse_dependency', 'depends_on', 'dependency_of', 'object', 'subject', true), ('carried_support', 'supports', 'supports', 'object', 'subject', true),
            ('switched_off', 'contradicts', 'contradicts', 'object', 'subject', false), ('no_such_relation', 'implemented_by', 'implements', 'object', 'subject', false)
            ) AS t(key, source_predicate, derive_predicate, subject_from, object_from, materialize)""",
        "document_types": """SELECT * FROM (VALUES ('note', 'proposed'), ('report', 'proposed'), ('memo', 'accepted')) AS t(key, default_claim_status)""",
        "entities": f"""SELECT 'customer.' || cast(c_custkey AS string) AS entity_id, 'Customer' AS entity_type, c_name AS label, {d.list("'C' || cast(c_custkey AS string)", "c_mktsegment")} AS aliases, 'active' AS status FROM customer
            UNION ALL SELECT 'supplier.' || cast(s_suppkey AS string), 'Supplier', s_name, {d.list("'S' || cast(s_suppkey AS string)")}, 'active' FROM supplier
            UNION ALL SELECT 'part.' || cast(p_partkey AS string), 'Part', p_name, {d.list("p_brand", "p_type")}, 'active' FROM part
            UNION ALL SELECT 'nation.' || cast(n_nationkey AS string), 'Nation', n_name, {d.list("lower(n_name)")}, 'active' FROM nation
            UNION ALL SELECT 'region.' || cast(r_regionkey AS string), 'Region', r_name, {d.list("lower(r_name)")}, 'active' FROM region
            UNION ALL SELECT 'priority.' || p, 'Priority', 'Priority ' || p, {d.list("p")}, 'active' FROM (VALUES ('1'), ('2'), ('3'), ('4'), ('5')) AS t(p)""",
        "docs": """SELECT 'doc.' || cast(d.doc_id AS string) AS document_id, CASE d.doc_id % 4 WHEN 0 THEN 'note' WHEN 1 THEN 'report' WHEN 2 THEN 'memo' ELSE CASE WHEN d.doc_id % 8 = 3 THEN 'unlisted' END END AS document_type,
            'docs/' || d.source || '/' || cast(d.doc_id AS string) || CASE d.doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.TXT' WHEN 2 THEN '.rst' WHEN 3 THEN '.pdf' ELSE '.markdown' END AS path,
            CASE WHEN l.toxic = 1 THEN 'archived' ELSE 'active' END AS status, 'Document ' || cast(d.doc_id AS string) AS title, d.text AS text
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
        "claims": f"""SELECT 'claim.' || cast(o_orderkey AS string) AS claim_id, 'customer.' || cast(o_custkey AS string) AS subject_id,
            CASE o_orderkey % 5 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'implemented_by' WHEN 2 THEN 'supports' WHEN 3 THEN 'contradicts' ELSE CASE WHEN o_orderkey % 150 = 4 THEN 'unheard_of' ELSE 'classifies_as' END END AS predicate,
            CASE WHEN o_orderkey % 5 = 4 THEN 'priority.' || substr(o_orderpriority, 1, 1) ELSE 'customer.' || cast((o_custkey * 7 + o_orderkey) % (SELECT count(*) + 100 FROM customer) AS string) END AS object_id,
            'Customer' AS subject_type, CASE WHEN o_orderkey % 5 = 4 THEN 'Priority' ELSE 'Customer' END AS object_type,
            CASE WHEN o_orderkey % 333 = 5 THEN 'weird' WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'proposed' WHEN o_orderkey % 9 = 0 THEN 'superseded' ELSE 'disputed' END AS status,
            cast(o_orderkey % 100 AS double) / 100 AS confidence, CASE WHEN o_orderkey % 61 = 2 THEN '' ELSE 'agent:loader' END AS asserted_by,
            {document.format('o_orderkey')} AS source_document_id,
            CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'seg:' || {document.format('(o_orderkey + cast(o_orderkey % 12 = 5 AS int))')} || ':001' WHEN o_orderkey % 44 = 2 THEN 'seg:none' ELSE 'seg:' || {document.format('o_orderkey')} || ':001' END AS source_segment_id,
            CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus = 'P' THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'needs_review' WHEN o_orderkey % 9 = 0 THEN 'archived' ELSE 'conflict_open' END AS review_state,
            {d.utc('o_orderdate')} AS valid_from, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 211 = 1 THEN '2026-02-30T00:00:00Z' ELSE {d.utc("o_orderdate + interval '180' day")} END AS valid_to,
            CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 <> 3 THEN 'human:reviewer' END AS reviewed_by, CASE WHEN o_orderstatus = 'F' THEN {d.utc('o_orderdate')} END AS reviewed_at,
            CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 40 = 1 THEN 'agent:bot' ELSE 'human:reviewer' END END AS decision_by, CASE WHEN o_orderstatus = 'F' THEN {d.utc('o_orderdate')} END AS decision_at,
            CASE WHEN o_orderstatus = 'F' AND o_orderkey % 45 <> 8 THEN 'checked' END AS decision_note, o_orderkey AS ord FROM orders""",
        "evidence": f"""SELECT CASE WHEN l_partkey % 499 = 3 THEN NULL ELSE 'ev.' || cast(l_orderkey AS string) || '.' || cast(l_linenumber AS string) END AS evidence_id, 'claim.' || cast(CASE WHEN l_partkey % 307 = 1 THEN -l_orderkey ELSE l_orderkey END AS string) AS claim_id,
            CASE WHEN l_partkey % 53 = 7 THEN 'doc.none' ELSE {document.format('l_orderkey')} END AS source_document_id,
            CASE WHEN l_partkey % 3 = 0 THEN NULL WHEN l_partkey % 97 = 1 THEN 'seg:none' WHEN l_partkey % 101 = 1 THEN 'seg:' || {document.format('(l_orderkey + 1)')} || ':001' ELSE 'seg:' || {document.format('l_orderkey')} || ':001' END AS source_segment_id,
            l_partkey % 500 AS start_char, l_partkey % 500 + CASE WHEN l_partkey % 71 = 5 THEN -5 ELSE cast(l_quantity AS bigint) * 40 END AS end_char,
            'excerpt' AS evidence_type, CASE WHEN l_returnflag = 'R' THEN 'oppose' WHEN l_partkey % 2 = 0 THEN ' Support ' ELSE 'support' END AS support, l_discount AS confidence,
            CASE WHEN l_suppkey % 37 = 5 THEN '' ELSE 'part ' || cast(l_partkey AS string) END AS excerpt, 'agent:loader' AS captured_by,
            l_partkey * 1000000000 + l_suppkey * 1000000 + cast(round(l_extendedprice * 100) AS bigint) % 1000000 AS ord FROM lineitem""",
    }


#: Windows of the star's segments, and the one segment in so many whose stored hash is wrong.
MAX_CHARS, OVERLAP, SPOILED = 1200, 150, 97


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    """The registry's DataFrames over sf_dir's Parquet tables; nothing is read yet."""
    frames: dict[str, DataFrame] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    for name, sql in views(SPARK).items():
        # Named frames stand in for the tables of the text.
        names = sorted(frames, key=len, reverse=True)
        frames[name] = _over(spark, sql, {n: frames[n] for n in names})
    docs = frames.pop("docs")
    segments = segment.star_segments(docs, MAX_CHARS, OVERLAP, SPOILED)
    return Registry(
        entities=frames["entities"], documents=docs, claims=frames["claims"], evidence=frames["evidence"], segments=segments,
        relations=frames["relations"], rules=frames["rules"], document_types=frames["document_types"],
    )


def _over(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    import re

    used = {n: f for n, f in frames.items() if re.search(rf"\b(?:FROM|JOIN) {n}\b", sql)}
    text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], sql)
    return spark.sql(text, **used)


def prelude() -> str:
    """The same views for DuckDB, as the beginning of a WITH."""
    made = {**views(DUCKDB), "segments": segment.star_segments_sql(MAX_CHARS, OVERLAP, SPOILED)}
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in made.items())
