"""The whole check of a registry in files: its rows, its files, its index and its mirror; and reports of what was found."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from claimloom.operators import index, mirror, validate
from claimloom.plans.registry import SCHEMA_VERSION, Registry
from claimloom.sources import bundle, fingerprint, shared


def optional_issues(spark: SparkSession, root: str) -> list[tuple[str, str, str, str]]:
    """Files that a registry may do without, and its settings."""
    out = [("warning", "optional.output_missing", bundle.PATHS[k], "") for k in ("shapes", "context") if not shared.exists(spark, f"{root}/{bundle.PATHS[k]}")]
    at = bundle.PATHS["settings"]
    if not shared.exists(spark, f"{root}/{at}"):
        return [*out, ("warning", "retrieval.config_missing", at, "")]
    try:
        bundle.load_yaml(spark, f"{root}/{at}")
    except Exception as e:  # noqa: BLE001  what a broken file raises is the parser's affair
        out.append(("error", "yaml.parse_failed", at, str(e)[:200]))
    return out


def index_issues(spark: SparkSession, root: str, segments: DataFrame, strict: bool = False) -> list[tuple[str, str, str, str]]:
    """Whether the index is there, can be read, and was made of the segments at hand; nothing without segments' file."""
    at = f"{bundle.PATHS['index']}/{index.META}"
    if not shared.exists(spark, f"{root}/warehouse/jsonl/segments.jsonl"):
        return []
    if not shared.exists(spark, f"{root}/{at}"):
        return [(level, code, at, "") for level, code in validate.index_issues(None, "", strict)]
    meta, found = bundle.load_json(spark, f"{root}/{at}")
    if found or not isinstance(meta, dict):
        return [(level, code, at, detail) for level, code, _, detail in found]
    return [(level, code, at, "") for level, code in validate.index_issues(str(meta.get("segment_source_hash")), index.source_hash(segments), strict)]


def mirror_issues(spark: SparkSession, root: str, sources: DataFrame, strict: bool = False) -> DataFrame:
    """Whether the mirror is there, can be read, has its ledger, and agrees with the sources (as mirror.counts gives them, with their hashes)."""
    at = bundle.PATHS["mirror"]
    none = lambda level, code, detail="": spark.createDataFrame([(level, code, at, detail)], bundle.FINDING)
    if not shared.exists(spark, f"{root}/{at}"):
        return none("warning", "mirror.missing")
    if not shared.exists(spark, f"{root}/{at}/_ledger"):
        return none("error", "mirror.meta_missing")
    try:
        ledger = mirror.read_ledger(spark, f"{root}/{at}")
    except Exception as e:  # noqa: BLE001  the store says what it could not read
        return none("error", "mirror.open_failed", str(e)[:200])
    return validate.mirror_issues(ledger, sources, strict)


def sync_mirror(spark: SparkSession, root: str) -> DataFrame:
    """Mirror the registry in a folder, with its files' fingerprints in the ledger; returns the ledger."""
    return mirror.sync(bundle.load(spark, root), f"{root}/{bundle.PATHS['mirror']}", fingerprint.of_sources(spark, root, bundle.SOURCES))


def check(spark: SparkSession, root: str, strict: bool = False) -> tuple[Registry, DataFrame]:
    """The registry in a folder and every finding: of its files, rows, index and mirror."""
    registry, found = bundle.read(spark, root)
    small = [*optional_issues(spark, root), *index_issues(spark, root, registry.segments, strict)]
    sources = mirror.state(registry, fingerprint.of_sources(spark, root, bundle.SOURCES))
    for part in (validate.issues(registry), spark.createDataFrame(small, bundle.FINDING), mirror_issues(spark, root, sources, strict)):
        found = found.unionByName(part)
    return registry, found


def rendered(found: DataFrame, root: str, as_json: bool = False, shown: int = 1000) -> tuple[str, int]:
    """(text, exit status) of a report: the summary and the first findings by level, code and record; status 1 if there is any error.

    The limit is the report's; the counts are of all findings.
    """
    found = shared.written(found, "findings")  # looked at twice, made once
    total = validate.summary(found).first()
    rows = [r.asDict() for r in found.orderBy("level", "code", "record", "detail").limit(shown).collect()]
    shared.drop(found)
    if as_json:
        text = json.dumps({"root": root, "summary": total.asDict(), "errors": [r for r in rows if r["level"] == "error"], "warnings": [r for r in rows if r["level"] == "warning"]}, indent=2)
    else:
        lines = [f"Root: {root}", f"Status: {total.status}", f"Errors: {total.errors}", f"Warnings: {total.warnings}"]
        for level, title in (("error", "Errors"), ("warning", "Warnings")):
            mine = [r for r in rows if r["level"] == level]
            lines += ["", f"{title}:", *(f"- [{r['code']}] {r['record']}" + f" ({r['detail']})" * bool(r["detail"]) for r in mine)] if mine else []
        text = "\n".join(lines)
    return text + "\n", int(total.errors > 0)


__all__ = ["SCHEMA_VERSION", "check", "index_issues", "mirror_issues", "optional_issues", "rendered", "sync_mirror"]
