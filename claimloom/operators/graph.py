"""Projecting the registry into a property graph, and bounded traversal of it.

Families are narrow selects put together by UNION ALL. Traversal is a loop of joins over the hops:
the frontier meets the adjacency table, new nodes are those not yet visited, and of several parents
at the least depth the smallest by name is kept, so paths do not depend on row order. The adjacency is
written once and read at every hop; each hop's nodes are written too, which frees the shuffles behind them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import match_form, present
from claimloom.plans.registry import Registry
from claimloom.sources.shared import drop, freeing, written

# Families of nodes (table, key, type) and of edges.
NODE_FAMILIES = {
    "entities": ("entities", "entity_id", "entity", "Entity"),
    "documents": ("documents", "document_id", "document", "Document"),
    "segments": ("segments", "segment_id", "segment", "Segment"),
    "claims": ("claims", "claim_id", "claim", "Claim"),
    "evidence": ("evidence", "evidence_id", "evidence", "Evidence"),
}
EDGE_FAMILIES = ["claim_predicates", "derived_relations", "claim_evidence", "evidence_segments", "claim_segments", "segment_documents", "segment_mentions"]


def name(kind: str, x: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), x)


def nodes(registry: Registry, ordered: bool = False) -> DataFrame:
    """family, node_id, node_type, source_id, payload (JSON of the row). ordered: each family by its ids, sorted before the JSON is made of the rows."""
    out = None
    for family, (source, key, kind, type_) in NODE_FAMILIES.items():
        rows = getattr(registry, source)
        rows = rows.filter(present(F.col(key)))
        part = (rows.orderBy(key) if ordered else rows).select(
            F.lit(family).alias("family"), name(kind, F.col(key)).alias("node_id"), F.lit(type_).alias("node_type"), F.col(key).alias("source_id"), F.to_json(F.struct(*rows.columns)).alias("payload")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _edge(rows: DataFrame, family: str, edge_id: list, type_: Column, source: Column, target: Column, *payload: str, ordered: bool = False) -> DataFrame:
    id_ = F.concat_ws(".", F.lit("edge"), *edge_id)
    return (rows.orderBy(id_) if ordered else rows).select(
        F.lit(family).alias("family"), id_.alias("edge_id"), type_.alias("edge_type"), source.alias("from_id"), target.alias("to_id"), F.to_json(F.struct(*payload)).alias("payload")
    )


def claim_predicates(registry: Registry, include_nonaccepted: bool = False, ordered: bool = False) -> DataFrame:
    """An edge from subject to object for each accepted claim, or each claim."""
    rows = registry.claims if include_nonaccepted else registry.claims.filter("status = 'accepted'")
    rows = rows.filter(present(F.col("claim_id")) & present(F.col("subject_id")) & present(F.col("object_id")) & present(F.col("predicate")))
    return _edge(rows, "claim_predicates", [F.lit("claim_predicate"), "claim_id"], F.col("predicate"), name("entity", F.col("subject_id")), name("entity", F.col("object_id")), "claim_id", "predicate", "status", "confidence", "review_state", ordered=ordered)


def edges(registry: Registry, include_nonaccepted: bool = False, ordered: bool = False) -> DataFrame:
    """family, edge_id, edge_type, from_id, to_id, payload. A null id is an absent one. ordered: as nodes() takes it."""
    both: Callable[[DataFrame, str, str], DataFrame] = lambda rows, a, b: rows.filter(present(F.col(a)) & present(F.col(b)))
    out = claim_predicates(registry, include_nonaccepted, ordered)
    plain = (
        (registry.segments, "segment_documents", "SEGMENT_DOCUMENT", ("segment", "segment_id"), ("document", "document_id")),
        (registry.claims, "claim_segments", "CLAIM_SEGMENT", ("claim", "claim_id"), ("segment", "source_segment_id")),
        (registry.evidence, "claim_evidence", "HAS_EVIDENCE", ("claim", "claim_id"), ("evidence", "evidence_id")),
        (registry.evidence, "evidence_segments", "EVIDENCE_SEGMENT", ("evidence", "evidence_id"), ("segment", "source_segment_id")),
        (registry.segments.select("segment_id", F.explode("entity_ids").alias("entity_id")), "segment_mentions", "MENTIONS", ("segment", "segment_id"), ("entity", "entity_id")),
    )
    for rows, family, type_, (k, a), (j, b) in plain:
        stem = "segment_mentions" if family == "segment_mentions" else family.removesuffix("s")
        out = out.unionByName(_edge(both(rows, a, b), family, [F.lit(stem), a, b], F.lit(type_), name(k, F.col(a)), name(j, F.col(b)), a, b, ordered=ordered))
    if registry.derived is not None:
        rows = registry.derived.filter(present(F.col("edge_id")) & present(F.col("subject_id")) & present(F.col("object_id")) & present(F.col("predicate")))
        out = out.unionByName(_edge(rows, "derived_relations", [F.lit("derived"), "edge_id"], F.col("predicate"), name("entity", F.col("subject_id")), name("entity", F.col("object_id")), *rows.columns, ordered=ordered))
    return out


def summary(registry: Registry, include_nonaccepted: bool = False) -> DataFrame:
    """family, n for every family, empty ones too."""
    found = nodes(registry).select("family").unionByName(edges(registry, include_nonaccepted).select("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    listed = registry.claims.sparkSession.createDataFrame([(f,) for f in [*NODE_FAMILIES, *EDGE_FAMILIES]], "family string")
    return listed.join(found, "family", "left").select("family", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def seeds(registry: Registry, query: str) -> DataFrame:
    """entity_id of entities whose id, label or an alias is the query, or has it in it."""
    q = match_form(F.lit(query))
    forms = [match_form(F.col("entity_id")), match_form(F.col("label"))]
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), match_form)
    equal = forms[0].eqNullSafe(q) | forms[1].eqNullSafe(q) | F.array_contains(aliases, q)
    inside = (q != "") & (forms[0].contains(q) | forms[1].contains(q) | F.exists(aliases, lambda a: a.contains(q)))
    return registry.entities.filter(present(F.col("entity_id")) & (equal | inside)).select("entity_id").distinct()


def baseline(registry: Registry, seed: DataFrame) -> DataFrame:
    """kind, id of what a direct lookup finds: seeds, their accepted claims, and the claims' evidence and sources.

    Claims that touch a seed are two equi-joins put together, not one with an OR. Evidence counts by row.
    """
    accepted = registry.claims.filter("status = 'accepted'")
    mine = accepted.join(seed.withColumnRenamed("entity_id", "subject_id"), "subject_id", "left_semi").unionByName(accepted.join(seed.withColumnRenamed("entity_id", "object_id"), "object_id", "left_semi").select(accepted.columns))
    mine = mine.select("claim_id", "subject_id", "object_id", "source_segment_id", "source_document_id").distinct()
    shown = registry.evidence.join(mine.select("claim_id").distinct(), "claim_id", "left_semi")
    pick = lambda rows, kind, c: rows.select(F.lit(kind).alias("kind"), F.col(c).alias("id")).filter(present(F.col("id")))
    sets = [pick(seed, "entities", "entity_id"), pick(mine, "entities", "subject_id"), pick(mine, "entities", "object_id"), pick(mine, "claims", "claim_id")]
    sets += [pick(x, kind, c) for x in (mine, shown) for kind, c in (("segments", "source_segment_id"), ("documents", "source_document_id"))]
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct().unionByName(shown.select(F.lit("evidence").alias("kind"), F.coalesce("evidence_id", F.lit("")).alias("id")))


def adjacency(registry: Registry) -> DataFrame:
    """a, b: both directions of every connection, once.

    Claims connect to their ends and segments if accepted; evidence connects to its claim whatever
    the claim's state, so claims that are not accepted can be reached through their evidence.
    """
    accepted = registry.claims.filter("status = 'accepted'")
    pairs = [
        (accepted, ("entity", "subject_id"), ("claim", "claim_id")),
        (accepted, ("claim", "claim_id"), ("entity", "object_id")),
        (accepted, ("claim", "claim_id"), ("segment", "source_segment_id")),
        (registry.evidence, ("claim", "claim_id"), ("evidence", "evidence_id")),
        (registry.evidence, ("evidence", "evidence_id"), ("segment", "source_segment_id")),
        (registry.segments, ("segment", "segment_id"), ("document", "document_id")),
        (registry.segments.select("segment_id", F.explode("entity_ids").alias("entity_id")), ("segment", "segment_id"), ("entity", "entity_id")),
    ]
    if registry.derived is not None:
        pairs.append((registry.derived, ("entity", "subject_id"), ("entity", "object_id")))
    out = None
    for rows, (k, a), (j, b) in pairs:
        part = rows.filter(present(F.col(a)) & present(F.col(b))).select(name(k, F.col(a)).alias("a"), name(j, F.col(b)).alias("b"))
        out = part if out is None else out.unionByName(part)
    # One pass over the sources and one shuffle: each connection once, in order of its ends, then turned to its two directions.
    once = out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select(F.inline(both))


def bfs(links: DataFrame, seed: DataFrame, max_hops: int = 3) -> DataFrame:
    """node_id, depth, path of every node within so many hops of a seed (entity_id)."""
    links = written(links, "links")
    found = seed.select(name("entity", F.col("entity_id")).alias("node_id"), F.lit(0).alias("depth")).withColumn("path", F.array("node_id"))
    front = found
    for depth in range(1, max_hops + 1):
        # Of the links only those move that begin at a kind of node which the frontier has.
        kind = lambda c: F.substring_index(c, ":", 1)
        held = [r.kind for r in front.select(kind("node_id").alias("kind")).distinct().collect()]  # a few
        near = front.join(links.filter(kind("a").isin(held)), F.col("node_id") == F.col("a")).groupBy(F.col("b").alias("node_id")).agg(F.min_by("path", F.col("a")).alias("path"))
        near = near.join(found.select("node_id"), "node_id", "left_anti")
        front = near.select("node_id", F.lit(depth).alias("depth"), F.concat("path", F.array("node_id")).alias("path"))
        front = written(front, "front")
        found = found.unionByName(front)
    drop(links)
    return found


def kinds(registry: Registry) -> DataFrame:
    """node_id, kind of the nodes that exist."""
    # A node's name begins with its kind; taken by name alone, the rows are dealt out once for this and for a join by name.
    return nodes(registry).select("node_id", F.col("node_type").alias("kind")).dropDuplicates(["node_id"])


def reached(registry: Registry, found: DataFrame) -> DataFrame:
    """kind, n: counts by kind of node, Unknown where there is no such node."""
    return reached_ids(registry, found).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def reached_ids(registry: Registry, found: DataFrame) -> DataFrame:
    """kind, id of every reached node. A pack shows them in this order; they are rows, as a kind may have any number."""
    named = found.select("node_id").join(kinds(registry), "node_id", "left")
    return named.select(F.coalesce("kind", F.lit("Unknown")).alias("kind"), F.regexp_replace("node_id", "^[^:]*:", "").alias("id"))


def export(registry: Registry, folder: str, include_nonaccepted: bool = False, compression: str = "gzip") -> DataFrame:
    """Write nodes and edges as JSON lines, a folder for each family, in order of their ids; returns the summary.

    A family is made of its own table, one after the other, and the shuffle that sorts it goes before the next.
    JSON is many times the size of the tables that it is made of, so its files are compressed ("none": plain ones).
    """
    for rows, kind, families in ((nodes(registry, ordered=True), "nodes", NODE_FAMILIES), (edges(registry, include_nonaccepted, ordered=True), "edges", EDGE_FAMILIES)):
        for family in families:
            with freeing(registry.claims.sparkSession):
                rows.filter(F.col("family") == family).drop("family").write.mode("overwrite").option("compression", compression).json(f"{folder}/{kind}/{family}")
    out = summary(registry, include_nonaccepted)
    out.coalesce(1).orderBy("family").write.mode("overwrite").json(f"{folder}/summary")
    return out


def sample_paths(found: DataFrame, n: int = 6) -> DataFrame:
    """node_id, route of the first n reached nodes in order of name; the limit is the feature."""
    return found.filter("depth > 0").orderBy("node_id").limit(n).select("node_id", F.array_join("path", " -> ").alias("route"))


def uplift(registry: Registry, query: str, max_hops: int = 3) -> DataFrame:
    """measure, direct, graph, more: what traversal reaches beyond direct lookup."""
    seed = seeds(registry, query)
    direct = baseline(registry, seed).groupBy(F.col("kind").alias("measure")).agg(F.count(F.lit(1)).alias("direct"))
    plural = F.when(F.col("kind") == "Entity", "entities").when(F.col("kind") == "Evidence", "evidence").otherwise(F.concat(F.lower("kind"), F.lit("s")))
    walked = reached(registry, bfs(adjacency(registry), seed, max_hops)).filter("kind <> 'Unknown'").select(plural.alias("measure"), F.col("n").alias("graph"))
    listed = registry.claims.sparkSession.createDataFrame([(f,) for f in NODE_FAMILIES], "measure string")
    out = listed.join(direct, "measure", "left").join(walked, "measure", "left").select("measure", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("direct", "graph")))
    return out.withColumn("more", F.col("graph") - F.col("direct"))
