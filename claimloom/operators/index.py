"""An index of segments in files: brought up to date by deltas, and asked with a text.

A folder holds parts, each a Parquet table written once: a base with all rows, and deltas with the
rows that a sync found new or changed and, as tombstones, those that are gone. A small file (META) names
the parts in force, so that a reader never sees half a version; of several rows of an id the latest
part's counts. A sync compares ids and hashes and writes what differs, so that a change of one
row in a hundred writes about one byte in a hundred; vectors are made for changed texts only. Deltas that
are many or large are folded into a new base. Parts that went out of force stay for a time (KEEP) for
the readers that began with them.

Parts are cut by a hash of document_type, bounded in number, and sorted by status, so that a filter
on one skips folders and on the other row groups. A base can have a vector index of its own (ann): a
query then looks into a part of it, and into the deltas whole.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimloom.functions.text import encode_value, text_hash
from claimloom.operators import ann, vectors
from claimloom.sources import shared

META = "index_meta.json"
#: Seconds for which parts out of force are kept. Deltas, and their share of the rows, at which a sync makes a new base.
KEEP, MAX_DELTAS, MAX_SHARE = 86_400, 8, 0.2
#: Folders of a part.
BUCKETS = 32
_INNER = ["row_hash", "gone", "bucket"]


def meta_of(spark: SparkSession, folder: str) -> dict | None:
    """What the index in this folder was made of; None without one. ValueError if that cannot be read."""
    path = f"{folder}/{META}"
    return json.loads(shared.read_text(spark, path)) if shared.exists(spark, path) else None


def _bucket(document_type: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(document_type, F.lit(""))), F.lit(BUCKETS)).cast("int")


def _part(spark: SparkSession, folder: str, meta: dict, name: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(json.loads(meta["schema"]))).parquet(f"{folder}/{name}")


def _latest(spark: SparkSession, folder: str, meta: dict) -> DataFrame | None:
    """The deltas' rows, tombstones too, one for each id; None without deltas."""
    out = None
    for n, name in enumerate(meta["deltas"]):
        rows = _part(spark, folder, meta, name).withColumn("part", F.lit(n))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return None
    names = [c for c in out.columns if c != "part"]
    return out.groupBy("segment_id").agg(F.max_by(F.struct(*names), "part").alias("r")).select("r.*")


def _merged(spark: SparkSession, folder: str, meta: dict, where: dict[str, str] | None = None) -> DataFrame:
    """The rows in force that have these values, with the columns that only this module reads."""
    def narrowed(rows: DataFrame) -> DataFrame:
        for column, value in (where or {}).items():
            rows = rows.filter(F.col(column) == value)
            rows = rows.filter(F.col("bucket") == _bucket(F.lit(value))) if column == "document_type" else rows
        return rows

    base, latest = _part(spark, folder, meta, meta["base"]), _latest(spark, folder, meta)
    if latest is None:
        return narrowed(base)
    return narrowed(base).join(latest.select("segment_id"), "segment_id", "left_anti").unionByName(narrowed(latest.filter(~F.col("gone"))))


def table(spark: SparkSession, folder: str, where: dict[str, str] | None = None) -> DataFrame | None:
    """The rows in force: segment_id, text, text_hash, metadata as text, embedding; of those with certain values."""
    meta = meta_of(spark, folder)
    return _merged(spark, folder, meta, where).drop(*_INNER) if meta else None


def source_hash(segments: DataFrame) -> str:
    """A hash of the segments' ids and texts that does not hang on their order."""
    row = segments.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("segment_id", "text").cast("decimal(38,0)")).alias("h")).first()
    return f"{row.n}:{row.h or 0}"


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", "bucket")


def _write(rows: DataFrame, folder: str, kind: str, dealt: bool = False) -> str:
    """Write a part; dealt: the rows come dealt out by bucket."""
    name = f"{kind}-{uuid.uuid4().hex}"
    order = [c for c in ("bucket", "status", "segment_id") if c in rows.columns]
    with shared.freeing(rows.sparkSession):
        (rows if dealt else _dealt(rows)).sortWithinPartitions(*order).write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/{name}")
    return name


def _embedded(rows: DataFrame, config: dict) -> DataFrame:
    """The rows with their vectors; the hash embedding is made in the row, others are joined to it."""
    if config.get("provider", "hash") == "hash":
        return vectors.embed(rows, "segment_id", dimensions=int(config.get("dimensions", vectors.DIMENSIONS)), keep=rows.columns)
    return rows.join(vectors.provider(config)(rows, "segment_id"), "segment_id")


def _current(segments: DataFrame, settings: dict) -> DataFrame:
    """What the index should hold, without vectors: one row for each id, with a hash of text and metadata."""
    fields = [c for c in settings["metadata_fields"] if c in segments.columns and c != "segment_id"]
    statuses = [str(s) for s in settings["index"].get("include_statuses") or []]
    rows = segments.filter(F.col("status").isin(statuses)) if statuses else segments
    lists = {c for c, t in rows.dtypes if t.startswith("array")}
    rows = rows.select("segment_id", F.coalesce("text", F.lit("")).alias("text"), text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"), *(encode_value(F.col(c)).alias(c) if c in lists else F.col(c).cast("string").alias(c) for c in fields))
    whole = F.sha2(F.to_json(F.struct("text_hash", *fields), {"ignoreNullFields": "false"}).cast("binary"), 256)
    kind = F.col("document_type") if "document_type" in fields else F.lit(None).cast("string")
    return rows.dropDuplicates(["segment_id"]).withColumns({"row_hash": whole, "gone": F.lit(False), "bucket": _bucket(kind)})


def sync(segments: DataFrame, folder: str, settings: dict, reset: bool = False, keep: float = KEEP) -> dict:
    """Bring the index in the folder up to date with the segments; returns the new index_meta with counts of what was done.

    written: the rows of the part that this sync wrote, tombstones too. reset: forget what is there, and make all vectors anew.
    """
    spark = segments.sparkSession
    before = None if reset else meta_of(spark, folder)
    rows, model, embedded = _current(segments, settings), json.dumps(settings["embedding"], sort_keys=True), lambda x: _embedded(x, settings["embedding"])
    usable = before is not None and before["embedding"] == model
    nothing = rows.limit(0)
    known = _merged(spark, folder, before).select("segment_id", F.col("text_hash").alias("old_text"), F.col("row_hash").alias("old_row")) if usable else nothing.select("segment_id", F.col("text_hash").alias("old_text"), F.col("row_hash").alias("old_row"))
    both = rows.select("segment_id", "text_hash", "row_hash").join(known, "segment_id", "full")
    action = F.when(F.col("row_hash").isNull(), "delete").when(F.col("old_row").isNull(), "insert").when(F.col("text_hash") != F.col("old_text"), "change").when(F.col("row_hash") != F.col("old_row"), "metadata")
    changes = shared.written(both.select("segment_id", action.alias("action")).filter("action IS NOT NULL"), "index-changes")
    n = {r.action: r.n for r in changes.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    count = (before["segment_count"] if usable else 0) + n.get("insert", 0) - n.get("delete", 0)
    of = lambda *actions: rows.join(changes.filter(F.col("action").isin(*actions)).select("segment_id"), "segment_id", "left_semi")
    fresh = of("insert", "change") if usable else rows
    # Rows are dealt out before they have vectors, which are larger than most texts.
    new = embedded(_dealt(fresh))
    if usable and n.get("metadata"):
        new = new.unionByName(_dealt(of("metadata").join(_merged(spark, folder, before).select("segment_id", "embedding"), "segment_id")))
    schema = new.schema
    parts, written = {"base": before["base"], "deltas": before["deltas"], "delta_rows": before["delta_rows"], "schema": before["schema"]} if usable else {}, sum(n.values())
    if not usable:
        # Ids that the old index alone has are gone with it.
        parts = {"base": _write(new, folder, "base", dealt=True), "deltas": [], "delta_rows": 0, "schema": schema.json()}
    elif [f.name for f in schema] != [f.name for f in StructType.fromJson(json.loads(before["schema"]))]:
        # Other metadata fields: every row is written, with the vector that it has.
        held = _merged(spark, folder, before).select("segment_id", "text_hash", "embedding")
        kept = rows.join(held, ["segment_id", "text_hash"]).select(schema.names)
        fresh = embedded(fresh).select(schema.names)
        parts = {"base": _write(kept.unionByName(fresh), folder, "base"), "deltas": [], "delta_rows": 0, "schema": schema.json()}
    elif written and (len(parts["deltas"]) >= MAX_DELTAS or parts["delta_rows"] + written > MAX_SHARE * max(count, 1)):
        # A delta would be folded at once: the new base is made of what stays and what is new, and the delta is not written.
        stay = _merged(spark, folder, before).join(changes.select("segment_id"), "segment_id", "left_anti").select(schema.names)
        parts = {**parts, "base": _write(_dealt(stay).unionByName(new), folder, "base", dealt=True), "deltas": [], "delta_rows": 0}
    elif written:
        gone = changes.filter("action = 'delete'").select("segment_id")
        tombs = gone.select("segment_id", *(F.lit(True).alias("gone") if f.name == "gone" else F.lit(0).alias("bucket") if f.name == "bucket" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name != "segment_id"))
        parts = {**parts, "deltas": [*parts["deltas"], _write(new.unionByName(tombs), folder, "delta", dealt=True)], "delta_rows": parts["delta_rows"] + written}
    meta = {
        "collection_name": settings["collection"]["name"], "version": uuid.uuid4().hex, "embedding": model, "distance": settings["index"]["distance"], "segment_source_hash": source_hash(segments), "segment_count": count,
        "segmenter_version": settings["segmenter"]["version"], "synced_at": datetime.now(UTC).isoformat(), **parts, "ann": before.get("ann") if usable and before["base"] == parts["base"] else None, "retired": (meta_of(spark, folder) or {}).get("retired", {}),
    }
    _commit(spark, folder, meta_of(spark, folder), meta, keep)
    shared.drop(changes)
    deleted = n.get("delete", 0)
    if before is not None and not usable:
        deleted = vectors.stale(_merged(spark, folder, before), rows).count()
    return {**meta, "upserted": count, "embedded": n.get("insert", 0) + n.get("change", 0), "deleted": deleted, "written": written}


def _parts(meta: dict | None) -> list[str]:
    return [meta["base"], *meta["deltas"], *([meta["ann"]] if meta["ann"] else [])] if meta else []


def _commit(spark: SparkSession, folder: str, old: dict | None, meta: dict, keep: float) -> None:
    """Put a version in force, then delete the parts that went out of it long enough ago."""
    now = time.time()
    retired = meta["retired"] | {p: now for p in _parts(old) if p not in _parts(meta)}
    due = [p for p, at in retired.items() if now - at >= keep]
    meta["retired"] = {p: at for p, at in retired.items() if p not in due}
    shared.write_text(spark, f"{folder}/{META}", json.dumps(meta, indent=2, sort_keys=True) + "\n")
    for p in due:
        shared.remove(spark, f"{folder}/{p}")


def build_ann(spark: SparkSession, folder: str, keep: float = KEEP, **options) -> dict:
    """Make the vector index of the base, folding deltas into it first; returns the new index_meta."""
    old = meta_of(spark, folder)
    meta = dict(old)
    if meta["deltas"]:
        meta |= {"base": _write(_merged(spark, folder, meta), folder, "base"), "deltas": [], "delta_rows": 0}
    meta["ann"] = f"ann-{uuid.uuid4().hex}"
    ann.build(_part(spark, folder, meta, meta["base"]), "segment_id", f"{folder}/{meta['ann']}", meta["distance"], **options)
    _commit(spark, folder, old, meta, keep)
    return meta


def _near(spark: SparkSession, folder: str, meta: dict, probe: list[float], k: int, where: dict[str, str], space: str, probes: int | None) -> DataFrame:
    """The k nearest rows by the base's vector index, and by a scan of the deltas.

    Rows that are superseded or filtered out do not count: more are asked for until k are left; past what the index
    answers all rows are scanned.
    """
    index, latest = ann.Index(spark, f"{folder}/{meta['ann']}"), _latest(spark, folder, meta)
    asked = spark.createDataFrame([("query", probe)], "query string, embedding array<double>")
    alive = _part(spark, folder, meta, meta["base"])
    alive = alive if latest is None else alive.join(latest.select("segment_id"), "segment_id", "left_anti")
    for column, value in where.items():
        alive = alive.filter(F.col(column) == value)
    wanted = k
    while wanted <= index.most:
        found = [r.key for r in index.search(asked, "query", wanted, probes).collect()]
        live = alive.filter(F.col("segment_id").isin(found))
        if len(found) < wanted or live.select("segment_id").count() >= k:
            if latest is not None:
                live = live.unionByName(latest.filter(~F.col("gone")))
            return vectors.top_k(live, probe, "segment_id", k, where, space)
        wanted *= 2
    return vectors.top_k(_merged(spark, folder, meta, where), probe, "segment_id", k, where, space)


def retrieve(spark: SparkSession, folder: str, query: str, settings: dict, k: int | None = None, document_type: str | None = None, status: str | None = None, approximate: bool = False, probes: int | None = None) -> DataFrame:
    """The k segments nearest to the query's text, with list-valued metadata read back.

    approximate: by the base's vector index, if it has one (build_ann), looking into so many of its lists; else by a scan.
    """
    meta = meta_of(spark, folder)
    if meta is None:
        raise FileNotFoundError(f"no index in {folder}")
    probe = vectors.provider(settings["embedding"])(spark.createDataFrame([("query", query)], "id string, text string"), "id").first().embedding
    where = {c: v for c, v in (("document_type", document_type), ("status", status)) if v}
    k, space = k or int(settings["index"]["top_k_default"]), settings["index"]["distance"]
    if approximate and meta["ann"] and space == meta["distance"]:
        found = _near(spark, folder, meta, list(probe), k, where, space, probes)
    else:
        found = vectors.top_k(_merged(spark, folder, meta, where), list(probe), "segment_id", k, where, space)
    found = vectors.decoded(found)
    return found.select(*(c for c in ("segment_id", "document_id", "text", "distance", "entity_ids", "claim_ids", "tags", "document_type", "status") if c in found.columns))
