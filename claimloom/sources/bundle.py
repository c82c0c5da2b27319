"""Reading and writing a registry as files: JSON lines, YAML manifests, text documents.

Row files are read by Spark with declared schemas; manifests and settings are small and are read on
the driver, through Spark's file systems, so that a registry may lie in any store. A line that is no JSON object is kept apart as a finding, the others stay (a file is not
void for one bad line). A null id counts as absent.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.dq import issue
from claimloom.operators.segment import MAX_CHARS, OVERLAP, VERSION
from claimloom.operators.vectors import DIMENSIONS, METADATA, TOP_K
from claimloom.plans.registry import Registry
from claimloom.sources import shared

SCHEMAS = {
    "entities": "entity_id string, entity_type string, label string, aliases array<string>, status string",
    "documents": "document_id string, path string, document_type string, status string, title string",
    "claims": "claim_id string, subject_id string, predicate string, object_id string, subject_type string, object_type string, status string, confidence double, asserted_by string,"
    " source_document_id string, source_segment_id string, review_state string, reviewed_by string, reviewed_at string, decision_by string, decision_at string, decision_note string, valid_from string, valid_to string",
    "claim_evidence": "evidence_id string, claim_id string, source_document_id string, source_segment_id string, start_char string, end_char string, evidence_type string, support string, confidence double, excerpt string, captured_by string",
    "segments": "segment_id string, document_id string, document_type string, text string, start_char string, end_char string, ordinal string, status string, text_hash string, segmenter_version string,"
    " heading_path array<string>, claim_ids array<string>, entity_ids array<string>, tags array<string>",
    "derived_edges": "edge_id string, source_claim_id string, rule_key string, subject_id string, predicate string, object_id string, status string, derived_at string, confidence double, valid_from string, valid_to string",
}
MANIFESTS = {
    "relations": "key string, label string, exclusive_object boolean, evidence_required boolean",
    "document_types": "key string, default_claim_status string",
    "rules": "key string, source_predicate string, derive_predicate string, subject_from string, object_from string, materialize boolean",
}
#: Where the parts of a registry lie under its root.
PATHS = {
    "relations": "intelligence/manifests/relations.yaml", "document_types": "intelligence/manifests/document_types.yaml", "rules": "intelligence/rules/inference.yaml", "shapes": "intelligence/shapes/core.shapes.yaml",
    "context": "intelligence/context/context.jsonld", "settings": "intelligence/retrieval/collection.yaml", "index": "vector/index", "mirror": "warehouse/mirror",
}
#: The file of each table that a mirror has, by the mirror's names.
SOURCES = {n: f"warehouse/jsonl/{n}.jsonl" for n in SCHEMAS} | {n: PATHS[n] for n in ("relations", "document_types")}
#: What the registry itself keeps under its root.
OWN = [*(f"warehouse/jsonl/{n}.jsonl" for n in SCHEMAS), PATHS["mirror"], PATHS["index"]]
#: Settings of the retrieval part; a file's values replace these, maps key by key.
SETTINGS = {
    "collection": {"name": "segments"},
    "embedding": {"provider": "hash", "dimensions": DIMENSIONS},
    "index": {"distance": "cosine", "batch_size": 64, "top_k_default": TOP_K, "segment_source": "warehouse/jsonl/segments.jsonl", "include_statuses": ["active"]},
    "metadata_fields": METADATA,
    "segmenter": {"version": VERSION, "max_chars": MAX_CHARS, "overlap_chars": OVERLAP},
}


def merged(base: dict, over: dict) -> dict:
    """over laid on base, maps merged key by key at any depth."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(spark: SparkSession, root: str | None, required: bool = False) -> dict:
    """The settings under a root, laid on the defaults. ValueError if they are no mapping; FileNotFoundError without a file that is required."""
    path = f"{root}/{PATHS['settings']}"
    if root is None or not shared.exists(spark, path):
        if required:
            raise FileNotFoundError(path)
        return merged(SETTINGS, {})
    found = load_yaml(spark, path)
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no mapping")
    return merged(SETTINGS, found)


def load_yaml(spark: SparkSession, path: str):
    import yaml

    return yaml.safe_load(shared.read_text(spark, path)) or {}


def load_json(spark: SparkSession, path: str) -> tuple[object, list[tuple[str, str, str, str]]]:
    """(value, findings) of a small JSON file."""
    try:
        return json.loads(shared.read_text(spark, path)), []
    except ValueError as e:
        return None, [("error", "json.parse_failed", path, str(e)[:200])]


ORDER = "struct<file: string, start: bigint, line: bigint>"


def rows(spark: SparkSession, path: str, schema: str, required: bool = True, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, findings) of a JSON-lines file, or of a folder of them; without it no rows, and a finding if it is required.

    ord, of type ORDER, sorts the rows as they stand in the file, or in the files by name.

    strict: a missing file and a line that is no object raise, the latter when the rows are read.
    """
    name = path.rstrip("/").rpartition("/")[2]
    if not shared.exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        empty = spark.createDataFrame([], schema + f", raw string, ord {ORDER}")
        lost = spark.createDataFrame([(name,)] if required else [], "file string")
        return empty, issue(lost, "error", "jsonl.missing", F.col("file"))
    # Spark packs cuts of files into partitions by size: a line's place is its file, the cut's beginning, and its number in the partition, which rises within a cut.
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), place.alias("ord")).filter(F.trim("value") != "")
    parsed = lines.withColumn("v", F.try_parse_json("value")).withColumn("ok", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    if strict:
        parsed = parsed.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit(f"{name}: no JSON object: "), F.substring("value", 1, 80))).cast("boolean")))
    good = parsed.filter("ok").select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw"), "ord").select("r.*", "raw", "ord")
    return good, issue(parsed.filter(~F.col("ok")), "error", "jsonl.parse_failed", F.lit(name), F.substring("value", 1, 80))


def manifest(spark: SparkSession, path: str, section: str, schema: str, key: str = "key", required: bool = True) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rows, findings) of a list in a YAML manifest, by key: first of equal keys, none without one."""
    names = [c.split()[0] for c in schema.split(", ")]
    found: list[tuple[str, str]] = []
    kept: dict[str, tuple] = {}
    if not shared.exists(spark, path):
        return spark.createDataFrame([], schema), [("yaml.missing", path)] if required else []
    try:
        data = load_yaml(spark, path)
    except Exception as e:  # noqa: BLE001  what a broken file raises is the parser's affair
        return spark.createDataFrame([], schema), [("yaml.parse_failed", str(e)[:200])]
    if not isinstance(data, dict):
        found.append(("yaml.invalid_root", path))
        data = {}
    if isinstance(data, dict) and data and section not in data:
        found.append(("yaml.missing_section", section))
    items = data.get(section, [] if section not in data else None)
    if not isinstance(items, list):
        found.append(("yaml.invalid_section", section))
        items = []
    for x in items:
        if not isinstance(x, dict):
            found.append(("yaml.invalid_item", str(x)[:80]))
        elif not x.get(key):
            found.append(("yaml.missing_key", section))
        elif str(x[key]) in kept:
            found.append(("yaml.duplicate_key", str(x[key])))
        else:
            x = {"materialize": True, "exclusive_object": False, **x}
            kept[str(x[key])] = tuple(x.get(n) for n in names)
    return spark.createDataFrame(list(kept.values()), schema), found


def texts(spark: SparkSession, root: str, documents: DataFrame) -> DataFrame:
    """The documents with their whole text: \\n line ends, no byte order mark; null where there is no file."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = shared.under(spark, root, F.col("_metadata.file_path"))
    # The registry's own tables lie under the same root and can be of any size: unless a document names one, Spark leaves them out by their paths, unread.
    own = lambda c: reduce(Column.__or__, ((c == p) | c.startswith(f"{p}/") for p in OWN))
    if not documents.filter(own(F.col("path"))).limit(1).count():
        files = files.filter(~own(path))
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    path = shared.under(spark, root, F.col("file"))
    clean = F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n?", "\n")
    return documents.join(files.select(path.alias("path"), clean.alias("text")), "path", "left")


def within(documents: DataFrame, folder: str, root: str | None = None) -> DataFrame:
    """The documents whose path lies in the folder (given from the root, as paths are; the root itself keeps all).

    A folder outside the root is a ValueError, and one that is not there, if a root is given to look, a FileNotFoundError.
    """
    at = posixpath.normpath(folder.lstrip("/") or ".")
    if at == ".." or at.startswith("../"):
        raise ValueError(f"{folder} is not under the root")
    if root is not None and not shared.is_folder(documents.sparkSession, f"{root}/{at}"):
        raise FileNotFoundError(f"{root}/{at}")
    return documents if at == "." else documents.filter(F.col("path").startswith(at + "/"))


def file_issues(documents: DataFrame) -> DataFrame:
    """Documents that name a file which is not there; documents as texts() gives them."""
    lost = documents.filter(F.col("path").isNotNull() & (F.col("path") != "") & F.col("text").isNull())
    return issue(lost, "warning", "documents.missing_path", F.col("document_id"), F.col("path"))


def read(spark: SparkSession, root: str, strict: bool = False) -> tuple[Registry, DataFrame]:
    """The registry in a folder, and the findings of reading it: level, code, record, detail."""
    at = lambda n: f"{root}/warehouse/jsonl/{n}.jsonl"
    table, found = {}, []
    for n, schema in SCHEMAS.items():
        table[n], lost = rows(spark, at(n), schema, n not in ("segments", "derived_edges"), strict and n not in ("segments", "derived_edges"))
        found.append(lost)
    part, small = {}, []
    for n, section in (("relations", "relations"), ("document_types", "document_types"), ("rules", "rules")):
        part[n], codes = manifest(spark, f"{root}/{PATHS[n]}", section, MANIFESTS[n], required=n != "rules")
        small += [("error", code, PATHS[n], detail) for code, detail in codes]
    documents = texts(spark, root, table["documents"])
    registry = Registry(
        entities=table["entities"], documents=documents, claims=table["claims"], evidence=table["claim_evidence"], segments=table["segments"], derived=table["derived_edges"], **part
    )
    out = file_issues(documents)
    for lost in [*found, spark.createDataFrame(small, FINDING)]:
        out = out.unionByName(lost)
    return registry, out


FINDING = "level string, code string, record string, detail string"


def load(spark: SparkSession, root: str) -> Registry:
    """The registry in a folder: warehouse/jsonl/*.jsonl and the files of PATHS."""
    return read(spark, root)[0]


def write_rows(df: DataFrame, path: str, order: Iterable[str] = (), sort_keys: bool = False) -> None:
    """Overwrite a folder of JSON lines, in order of the columns named; sort_keys: each line's keys in order."""
    df = df.orderBy(*order) if list(order) else df
    df = df.select(*(F.col(f"`{c}`") for c in sorted(df.columns))) if sort_keys else df
    df.write.mode("overwrite").json(path)


def write_json(spark: SparkSession, payload: object, path: str) -> None:
    """Overwrite a small file with indented JSON, keys in order."""
    shared.write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
