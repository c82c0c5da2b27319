"""Registered queries over files: registries, indexes and repositories laid down from the star tables, then read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.catalog import _EDGES, _NODES, STATUSES, _derived, on_registry, query
from claimloom.operators import ann, dq, graph, index, lint, mirror, report, validate, vectors
from claimloom.plans.registry import Registry
from claimloom.sources import bundle, fingerprint, shared

# --- rows ---


@on_registry("src_jsonl_scan", "SELECT claim_id, subject_id, status, confidence, source_segment_id, valid_to FROM claims")
def _(r: Registry) -> DataFrame:
    spark = r.claims.sparkSession
    path = shared.scratch_path(spark, "claims") + ".jsonl"
    names = ["claim_id", "subject_id", "status", "confidence", "source_segment_id", "valid_to"]
    lines = r.claims.select(F.to_json(F.struct(*names, F.lit(1).alias("more"))).alias("value"))
    # Every hundredth line or so is followed by a blank one, or by one that is no object.
    extra = r.claims.filter("ord % 97 = 0").select(F.when(F.col("ord") % 2 == 0, "  ").otherwise("[1, 2").alias("value"))
    lines.unionByName(extra).write.text(path)
    return bundle.rows(spark, path, bundle.SCHEMAS["claims"])[0].select(*names)


@on_registry("src_jsonl_findings", "SELECT 'error' AS level, 'jsonl.parse_failed' AS code, 'claims.jsonl' AS record, 'not ' || claim_id AS detail FROM claims WHERE ord % 53 = 0 UNION ALL SELECT 'error', 'jsonl.missing', 'claim_evidence.jsonl', ''")
def _(r: Registry) -> DataFrame:
    spark = r.claims.sparkSession
    root = shared.scratch_path(spark, "bundle")
    r.claims.select(F.when(F.col("ord") % 53 == 0, F.concat(F.lit("not "), "claim_id")).otherwise(F.to_json(F.struct("claim_id"))).alias("value")).write.text(f"{root}/claims.jsonl")
    found = bundle.rows(spark, f"{root}/claims.jsonl", bundle.SCHEMAS["claims"])[1]
    return found.unionByName(bundle.rows(spark, f"{root}/claim_evidence.jsonl", bundle.SCHEMAS["claim_evidence"])[1]).unionByName(bundle.rows(spark, f"{root}/segments.jsonl", bundle.SCHEMAS["segments"], required=False)[1])


@on_registry("src_odd_segment_ids", "SELECT claim_id AS record, ord::VARCHAR AS detail FROM okclaims WHERE ord % 41 = 0")
def _(r: Registry) -> DataFrame:
    """Claims whose segment is given as a number are no strings, and not unknown segments either."""
    spark = r.claims.sparkSession
    path = shared.scratch_path(spark, "claims") + ".jsonl"
    plain = F.to_json(F.struct("claim_id", "status", F.col("source_segment_id")))
    odd = F.to_json(F.struct("claim_id", "status", F.col("ord").alias("source_segment_id")))
    r.claims.select(F.when(F.col("ord") % 41 == 0, odd).otherwise(plain).alias("value")).write.text(path)
    claims = bundle.rows(spark, path, bundle.SCHEMAS["claims"])[0]
    read = Registry(**{**r.__dict__, "claims": claims})
    return validate.issues(read, ["claims.invalid_segment_id"]).select("record", "detail")


@on_registry("snk_rows_sorted", "SELECT row_number() OVER (ORDER BY edge_id) AS nth, edge_id, 'edge_id,predicate,rule_key,source_claim_id,status' AS keys FROM derived")
def _(r: Registry) -> DataFrame:
    spark = r.claims.sparkSession
    path = shared.scratch_path(spark, "edges")
    bundle.write_rows(_derived(r).select("status", "rule_key", "edge_id", "predicate", "source_claim_id"), path, ["edge_id"], sort_keys=True)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    # Files are in order of their names, lines in order within them: a line's number is that in its file after those of the files before.
    before = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))  # a row a file
    nth = F.row_number().over(Window.partitionBy("file").orderBy("start", "at"))
    return lines.withColumn("nth", nth).join(before, "file").select((F.col("before") + F.col("nth")).alias("nth"), F.get_json_object("value", "$.edge_id").alias("edge_id"), F.array_join(F.json_object_keys("value"), ",").alias("keys"))


@on_registry("src_order_files", "SELECT claim_id, CASE WHEN ord % 3 = 0 THEN 'first' WHEN ord % 3 = 1 THEN 'second' ELSE 'third' END AS label FROM claims")
def _(r: Registry) -> DataFrame:
    """Claims given in up to three files of one registry, the last the largest: the first file's row counts."""
    spark = r.claims.sparkSession
    path = shared.scratch_path(spark, "claims") + ".jsonl"
    for name, label, rows in (("a", "first", r.claims.filter("ord % 3 = 0")), ("b", "second", r.claims.filter("ord % 3 < 2")), ("c", "third", r.claims)):
        rows.select(F.to_json(F.struct("claim_id", F.lit(label).alias("status"), F.repeat(F.lit("x"), len(label) * 20).alias("more"))).alias("value")).write.text(f"{path}/{name}")
    rows = bundle.rows(spark, path, bundle.SCHEMAS["claims"])[0]
    return dq.first_by_key(rows, "claim_id", ["ord"]).select("claim_id", F.col("status").alias("label"))


@on_registry("mir_stale_content", "SELECT 'mirror.stale' AS code, 'claims' AS record FROM claims WHERE ord % 97 = 0 LIMIT 1")
def _(r: Registry) -> DataFrame:
    """A mirror of files of which one then gets other content, of as many rows: its fingerprint tells."""
    spark = r.claims.sparkSession
    root = shared.scratch_path(spark, "registry")
    at = lambda n: f"{root}/{bundle.SOURCES[n]}"
    texts = {"claims": r.claims.drop("ord"), "entities": r.entities, "documents": r.documents.select("document_id", "path"), "claim_evidence": r.evidence.filter("false").drop("ord")}
    for name, rows in texts.items():
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(at(name))
    for name, section in (("relations", "relations"), ("document_types", "document_types")):
        shared.write_text(spark, at(name), json.dumps({section: []}))
    report.sync_mirror(spark, root)
    shared.remove(spark, at("claims"))
    changed = r.claims.withColumn("asserted_by", F.when(F.col("ord") % 97 == 0, "agent:other").otherwise(F.col("asserted_by"))).drop("ord")
    changed.select(F.to_json(F.struct(*changed.columns)).alias("value")).write.text(at("claims"))
    sources = mirror.state(bundle.load(spark, root), fingerprint.of_sources(spark, root, bundle.SOURCES))
    return report.mirror_issues(spark, root, sources).select("code", "record")


_PARTS = f"SELECT 'nodes' AS part, family, node_id AS id FROM ({_NODES}) UNION ALL SELECT 'edges', family, edge_id FROM ({_EDGES})"


@on_registry("prj_export", f"SELECT part, family, count(*)::BIGINT AS n, min(id) AS least, max(id) AS most FROM ({_PARTS}) GROUP BY ALL")
def _(r: Registry) -> DataFrame:
    spark = r.claims.sparkSession
    folder = shared.scratch_path(spark, "graph")
    graph.export(r.with_derived(_derived(r)), folder)
    out = None
    for part, key, families in (("nodes", "node_id", graph.NODE_FAMILIES), ("edges", "edge_id", graph.EDGE_FAMILIES)):
        for family in families:
            rows = spark.read.schema(f"{key} string").json(f"{folder}/{part}/{family}")
            one = rows.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).select(F.lit(part).alias("part"), F.lit(family).alias("family"), "n", "least", "most")
            out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


# --- a registry in a folder, made of nations and regions ---


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A registry whose documents are nations and whose relations are regions; some of its files are missing or wrong."""
    root = shared.scratch_path(spark, "registry")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()  # 5 rows
    put = lambda path, text: shared.write_text(spark, f"{root}/{path}", text)
    lines = lambda rows: "".join(json.dumps(x) + "\n" for x in rows)
    put("warehouse/jsonl/entities.jsonl", lines({"entity_id": f"nation.{n.n_nationkey}", "label": n.n_name, "aliases": [n.n_name.lower()]} for n in nations) + "".join(f"not {n.n_nationkey}\n" for n in nations if n.n_nationkey % 7 == 3))
    put("warehouse/jsonl/documents.jsonl", lines({"document_id": f"doc.{n.n_nationkey}", "path": f"docs/{n.n_regionkey}/{n.n_nationkey}.md", "document_type": "note"} for n in nations))
    put("warehouse/jsonl/claims.jsonl", "")
    for n in nations:
        if n.n_nationkey % 5:
            put(f"docs/{n.n_regionkey}/{n.n_nationkey}.md", f"\ufeff# {n.n_name}\r\n\r\n{n.n_nationkey}\r\n")
    relations = [{"key": r.r_name, "label": r.r_name.lower()} for r in regions] + [{"key": r.r_name} for r in regions if r.r_regionkey % 2 == 0] + [{"label": "no key"}, "no map"]
    put(bundle.PATHS["relations"], json.dumps({"relations": relations}))  # JSON is YAML
    put(bundle.PATHS["document_types"], json.dumps({"other": []}))
    put(bundle.PATHS["rules"], "rules: [")
    put(bundle.PATHS["context"], "{}")
    put(f"{bundle.PATHS['index']}/{index.META}", "{broken")
    return root


def on_folder(name: str, sql: str, *tables: str):
    """A query over such a folder, and over given tables if it names any."""

    def add(f):
        query(name)(lambda spark, sf_dir: f(spark, _folder(spark, sf_dir), *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables)))
        from claimloom.catalog import ORACLES

        ORACLES[name] = sql
        return f

    return add


@on_folder("src_text_scan", "SELECT 'doc.' || n_nationkey AS document_id, CASE WHEN n_nationkey % 5 <> 0 THEN '# ' || n_name || chr(10) || chr(10) || n_nationkey || chr(10) END AS text FROM nation")
def _(spark: SparkSession, root: str) -> DataFrame:
    return bundle.load(spark, root).documents.select("document_id", "text")


@on_folder("src_within", "SELECT 'doc.' || n_nationkey AS document_id FROM nation WHERE n_regionkey = 2")
def _(spark: SparkSession, root: str) -> DataFrame:
    return bundle.within(bundle.load(spark, root).documents, "docs/1/../2/", root).select("document_id")


@on_folder("src_manifest", "SELECT r_name AS key, lower(r_name) AS label FROM region")
def _(spark: SparkSession, root: str) -> DataFrame:
    return bundle.load(spark, root).relations.select("key", "label")


@on_folder(
    "src_read_findings",
    """SELECT 'warning' AS level, 'documents.missing_path' AS code, 'doc.' || n_nationkey AS record FROM nation WHERE n_nationkey % 5 = 0
    UNION ALL SELECT 'error', 'jsonl.parse_failed', 'entities.jsonl' FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT 'error', 'yaml.duplicate_key', 'intelligence/manifests/relations.yaml' FROM region WHERE r_regionkey % 2 = 0
    UNION ALL SELECT 'error', c, r FROM (VALUES ('jsonl.missing', 'claim_evidence.jsonl'), ('yaml.missing_key', 'intelligence/manifests/relations.yaml'), ('yaml.invalid_item', 'intelligence/manifests/relations.yaml'),
      ('yaml.missing_section', 'intelligence/manifests/document_types.yaml'), ('yaml.parse_failed', 'intelligence/rules/inference.yaml')) t(c, r)""",
)
def _(spark: SparkSession, root: str) -> DataFrame:
    return bundle.read(spark, root)[1].select("level", "code", "record")


@on_folder(
    "val_files",
    """SELECT * FROM (VALUES ('warning', 'optional.output_missing', 'intelligence/shapes/core.shapes.yaml'), ('warning', 'retrieval.config_missing', 'intelligence/retrieval/collection.yaml'), ('warning', 'mirror.missing', 'warehouse/mirror')) t(level, code, record)
    UNION ALL SELECT 'error', 'json.parse_failed', 'vector/index/index_meta.json'
    UNION ALL SELECT DISTINCT 'warning', 'retrieval.index_stale', o_orderstatus || '/vector/index/index_meta.json' FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') AND o_totalprice > 400000""",
    "orders",
)
def _(spark: SparkSession, root: str, orders: DataFrame) -> DataFrame:
    """Findings on a registry's own files; and on an index of the orders of each status, of which the dear ones then got another text."""
    shared.write_text(spark, f"{root}/warehouse/jsonl/segments.jsonl", "")
    segments = bundle.load(spark, root).segments
    small = [*report.optional_issues(spark, root), *report.index_issues(spark, root, segments)]
    for status in ("F", "O", "P"):
        at = f"{root}/{status}"
        made_of = orders.filter(F.col("o_orderstatus") == status).select(F.concat(F.lit("order."), "o_orderkey").alias("segment_id"), F.col("o_orderpriority").alias("text"), "o_totalprice")
        now = made_of.withColumn("text", F.when(F.col("o_totalprice") > 400000, "dear").otherwise(F.col("text")))
        now.select(F.to_json(F.struct("segment_id", "text")).alias("value")).write.text(f"{at}/warehouse/jsonl/segments.jsonl", compression="gzip")
        shared.write_text(spark, f"{at}/{bundle.PATHS['index']}/{index.META}", json.dumps({"segment_source_hash": index.source_hash(made_of)}))
        found = report.index_issues(spark, at, bundle.rows(spark, f"{at}/warehouse/jsonl/segments.jsonl", bundle.SCHEMAS["segments"])[0])
        small += [(level, code, f"{status}/{record}", detail) for level, code, record, detail in found]
        shared.remove(spark, at)
    none = spark.createDataFrame([], "source_path string, source_hash string, row_count long, schema_version string")
    return spark.createDataFrame(small, bundle.FINDING).unionByName(report.mirror_issues(spark, root, none)).select("level", "code", "record")


@on_folder("val_folder", "SELECT code, n::BIGINT AS n FROM (SELECT 'documents.unknown_type' AS code, count(*) AS n FROM nation UNION ALL SELECT 'documents.missing_path', count(*) FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'mirror.missing', 1 UNION ALL SELECT 'jsonl.parse_failed', count(*) FROM nation WHERE n_nationkey % 7 = 3) WHERE n > 0")
def _(spark: SparkSession, root: str) -> DataFrame:
    named = ["documents.unknown_type", "documents.missing_path", "mirror.missing", "jsonl.parse_failed"]
    return report.check(spark, root)[1].filter(F.col("code").isin(named)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


# --- a repository, made of nations and regions ---


def _repository(spark: SparkSession, sf_dir: str) -> str:
    """A repository with something to find for nearly every code of the linter."""
    root = shared.scratch_path(spark, "repository")
    nations = [r.n_nationkey for r in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]  # 25 rows
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()  # 5 rows
    put = lambda path, text: shared.write_text(spark, f"{root}/{path}", text if isinstance(text, str) else json.dumps(text))
    head = "- Status: Active\n- Source of Truth: Yes\n\n"
    put("docs/README.md", head + "".join(f"See `docs/n{k}.md`.\n" for k in nations))
    for k in nations:
        if k % 3 == 0:
            put(f"docs/n{k}.md", "x\n")
    put("docs/CURRENT_STATE.md", "run-0\n\n## Current Truth\nnothing\n")
    put("docs/ARCHITECTURE.md", "- Status: Active\n- Source of Truth: maybe\n")
    put("docs/IMPACT_SUMMARY.md", head + "## Changed\n")
    for r in regions:
        put(f"docs/archive/r{r.r_regionkey}.md", "Status: Archived\n" + "Source of Truth: No\n" * (r.r_regionkey % 2 == 0))
    put("pyproject.toml", "[project.scripts]\n" + "".join(f'run-{r.r_regionkey} = "pkg.cli:main"\n' for r in regions))
    put("pkg/cli.py", "from pkg.legacy_io import read\n\ndef main():\n    pass\n")
    put("pkg/legacy_io.py", "def read(): ...\n")
    put("shapes/d0.yaml", "x: 1\n")
    put("intelligence/glossary.yaml", {"terms": [{"term": r.r_name, "status": "deprecated" if r.r_regionkey % 2 else "active"} for r in regions]})
    links = {0: "pkg.cli:main", 1: "pkg.cli:gone", 2: "nocolon", 3: "pkg.none:x"}
    actions = [{"key": f"a{k}", "status": "implemented", **({"capability": f"c{k}"} if k < 5 else {}), "touches_datasets": [f"d{k}"], **({"implementation": links[k]} if k in links else {})} for k in nations if k < 6]
    put("intelligence/manifests/actions.yaml", {"actions": [*actions, {"key": "a0"}, {"status": "none"}, "odd"]})
    put("intelligence/registry/capabilities.yaml", {"capabilities": [{"key": f"c{k}", "status": "active", **({"implementation": "pkg.cli:main"} if k != 1 else {})} for k in range(3)]})
    put("intelligence/manifests/datasets.yaml", {"datasets": [{"dataset_key": f"d{k}", "canonical_shape": f"shapes/d{k}.yaml", "used_by_actions": [f"a{k}", "zz"]} for k in range(4)]})
    put("intelligence/manifests/entities.yaml", {"entities": [{"key": "e0", "canonical_terms": [regions[0].r_name, "nothing"], "used_by_actions": ["a0", "nope"]}]})
    put("intelligence/handlers/h.yaml", {"emitted_by": ["a0", "ghost"], "chain": [{"action": "a0"}, {"action": "void"}, {"reason": "x"}, 5]})
    put("intelligence/handlers/broken.yaml", "a: [")
    put("changed.txt", "pkg\\cli.py\nintelligence/manifests/actions.yaml\n\n")
    return root


_A, _C, _D, _E, _H, _S = ("intelligence/manifests/actions.yaml", "intelligence/registry/capabilities.yaml", "intelligence/manifests/datasets.yaml", "intelligence/manifests/entities.yaml", "intelligence/handlers/h.yaml", "docs/CURRENT_STATE.md")
_LINT = f"""SELECT 'error' AS level, 'docs.broken_reference' AS code, 'docs/README.md' AS record, 'docs/n' || n_nationkey || '.md' AS detail FROM nation WHERE n_nationkey % 3 <> 0
UNION ALL SELECT 'error', 'docs.archive_banner_missing', 'docs/archive/r' || r_regionkey || '.md', '' FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT 'warning', 'docs.current_state_missing_console_script', '{_S}', string_agg('run-' || r_regionkey, ', ' ORDER BY r_regionkey) FROM region WHERE r_regionkey > 0
UNION ALL SELECT 'error', 'glossary.deprecated_unmapped', 'intelligence/glossary.yaml', r_name FROM region WHERE r_regionkey % 2 = 1
UNION ALL SELECT 'error', 'actions.capability_unknown', '{_A}', 'a' || n_nationkey || ' -> c' || n_nationkey FROM nation WHERE n_nationkey IN (3, 4)
UNION ALL SELECT 'error', 'actions.dataset_unknown', '{_A}', 'a' || n_nationkey || ' -> d' || n_nationkey FROM nation WHERE n_nationkey IN (4, 5)
UNION ALL SELECT 'error', 'datasets.canonical_shape_missing', '{_D}', 'd' || r_regionkey FROM region WHERE r_regionkey BETWEEN 1 AND 3
UNION ALL SELECT 'error', 'datasets.unknown_action', '{_D}', 'd' || r_regionkey || ' -> zz' FROM region WHERE r_regionkey < 4
UNION ALL SELECT * FROM (VALUES ('error', 'docs.missing_metadata', '{_S}', 'status, source_of_truth'), ('error', 'docs.invalid_source_of_truth', 'docs/ARCHITECTURE.md', ''),
  ('error', 'docs.impact_summary_incomplete', 'docs/IMPACT_SUMMARY.md', 'checked not changed, remaining drift, validator summary'), ('warning', 'docs.optional_missing', 'docs/LAYERS.md', ''),
  ('warning', 'docs.optional_missing', 'docs/SKILLS_INTEGRATION.md', ''), ('warning', 'docs.optional_missing', 'docs/ROADMAP.md', ''), ('warning', 'docs.legacy_runtime_dependency_missing', '{_S}', 'pkg/legacy_io.py'),
  ('error', 'actions.missing_capability', '{_A}', 'a5'), ('error', 'impl.symbol_missing', '{_A}', 'pkg.cli:gone'), ('error', 'impl.invalid_format', '{_A}', 'nocolon'), ('error', 'impl.unresolved', '{_A}', 'pkg.none:x'),
  ('error', 'impl.missing', '{_C}', ''), ('error', 'entities.unknown_term', '{_E}', 'e0 -> nothing'), ('error', 'entities.unknown_action', '{_E}', 'e0 -> nope'), ('error', 'handlers.unknown_emitter', '{_H}', ' -> ghost'),
  ('error', 'handlers.unknown_action', '{_H}', ' -> void'), ('error', 'handlers.missing_action', '{_H}', ''), ('error', 'handlers.invalid_step', '{_H}', ''), ('error', 'yaml.duplicate_key', '{_A}', 'a0'),
  ('error', 'yaml.missing_key', '{_A}', 'actions'), ('error', 'yaml.invalid_item', '{_A}', 'odd'), ('error', 'yaml.parse_failed', 'intelligence/handlers/broken.yaml', '*'),
  ('warning', 'drift.current_state_missing', '', ''), ('warning', 'drift.capability_sync_missing', '', '')) t(level, code, record, detail)"""


def on_repository(name: str, sql: str, *tables: str):
    """A query over such a repository, and over given tables if it names any."""

    def add(f):
        query(name)(lambda spark, sf_dir: f(spark, _repository(spark, sf_dir), *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables)))
        from claimloom.catalog import ORACLES

        ORACLES[name] = sql
        return f

    return add


@on_repository("lint_repository", _LINT)
def _(spark: SparkSession, root: str) -> DataFrame:
    found = lint.lint(spark, root, f"{root}/changed.txt")
    return found.withColumn("detail", F.when(F.col("code") == "yaml.parse_failed", "*").otherwise(F.col("detail")))


#: Paths that orders stand for, by o_orderkey % 4, and which orders are in a list of changed files.
_PATHS = {0: "docs/n{}.md", 1: "pkg/x{}.py", 2: "scripts/run{}.py", 3: "intelligence/handlers/h{}.yaml"}
_LISTS = {"code": "o_orderkey % 4 = 1", "docs": "o_orderkey % 4 < 2", "entry": "o_orderkey % 4 = 2", "handlers": "o_orderkey % 4 = 3", "dear": "o_totalprice > 400000 AND o_orderkey % 4 > 0", "open": "o_orderstatus = 'O'", "empty": "o_totalprice < 0"}
_CHANGED = " UNION ALL ".join(f"SELECT '{name}' AS list, count(*) AS n, coalesce(bool_or(o_orderkey % 4 IN (0, 3)), false) AS docs, coalesce(bool_or(o_orderkey % 4 IN (1, 2)), false) AS code, coalesce(bool_or(o_orderkey % 4 = 2), false) AS entry, coalesce(bool_or(o_orderkey % 4 = 3), false) AS handlers FROM orders WHERE {where}" for name, where in _LISTS.items())


@on_repository(
    "lint_drift",
    f"WITH facts AS ({_CHANGED}) SELECT list, 'drift.changed_files_empty' AS code FROM facts WHERE n = 0 UNION ALL SELECT list, 'drift.docs_sync_missing' FROM facts WHERE code AND NOT docs UNION ALL SELECT list, 'drift.current_state_missing' FROM facts WHERE entry"
    " UNION ALL SELECT list, 'drift.handler_sync_missing' FROM facts WHERE handlers UNION ALL SELECT * FROM (VALUES ('none', 'drift.changed_files_missing'), ('gone', 'drift.changed_files_not_found')) t(list, code)",
    "orders",
)
def _(spark: SparkSession, root: str, orders: DataFrame) -> DataFrame:
    """Lists of changed files, a path for each order in them."""
    repo = lint.open_repository(spark, root)
    path = F.coalesce(*(F.when(F.col("o_orderkey") % 4 == k, F.format_string(p.replace("{}", "%d"), "o_orderkey")) for k, p in _PATHS.items()))
    out = None
    for name in [*_LISTS, "gone", "none"]:
        if name in _LISTS:
            orders.filter(_LISTS[name]).select(path.alias("value")).write.text(f"{root}/lists/{name}.txt", compression="gzip")
        found = lint.drift_issues(repo, None if name == "none" else f"{root}/lists/{name}.txt").select(F.lit(name).alias("list"), "code")
        out = found if out is None else out.unionByName(found)
    return out


@on_repository(
    "lint_empty",
    """SELECT 'folder' AS root, c AS code FROM (VALUES ('docs.missing'), ('intelligence.missing')) t(c) UNION ALL SELECT 'owing', c FROM (VALUES ('docs.missing'), ('intelligence.missing')) t(c) UNION ALL SELECT 'file', 'repo.invalid' UNION ALL SELECT 'nothing', 'repo.missing'
    UNION ALL SELECT 'folder', 'drift.changed_files_empty' FROM customer HAVING count(*) = 0 UNION ALL SELECT 'folder', 'drift.docs_sync_missing' FROM customer HAVING bool_and(c_acctbal < 0) UNION ALL SELECT 'owing', 'drift.changed_files_empty' FROM customer HAVING count(*) FILTER (c_acctbal < 0) = 0
    UNION ALL SELECT 'owing', 'drift.docs_sync_missing' FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0""",
    "customer",
)
def _(spark: SparkSession, root: str, customer: DataFrame) -> DataFrame:
    """Roots that hold nothing to lint, with a list of changed files made of the customers: code of those who owe, documents of the others."""
    shared.write_text(spark, f"{root}/other/x.txt", "x")
    owes, out = F.col("c_acctbal") < 0, None
    path = F.when(owes, F.format_string("src/c%d.py", "c_custkey")).otherwise(F.format_string("docs/c%d.md", "c_custkey"))
    for name, at, listed in (("folder", "other", customer), ("owing", "other", customer.filter(owes)), ("file", "pyproject.toml", None), ("nothing", "nowhere", None)):
        if listed is not None:
            listed.select(path.alias("value")).write.text(f"{root}/lists/{name}.txt", compression="gzip")
        found = lint.lint(spark, f"{root}/{at}", f"{root}/lists/{name}.txt").select(F.lit(name).alias("root"), "code")
        out = found if out is None else out.unionByName(found)
    return out


@on_repository("lint_scripts", "SELECT 'run-' || r_regionkey AS name, 'pkg.cli:main' AS target, 'pkg/cli.py' AS file FROM region")
def _(spark: SparkSession, root: str) -> DataFrame:
    files = lint.open_repository(spark, root).files
    scripts = lint.console_scripts(files).withColumn("module", F.split("target", ":")[0])
    return scripts.join(lint.modules(files), "module").select("name", "target", "file")


# --- an index ---

QUERY = "the index of index and search"
_TEXTS = "(SELECT segment_id, text FROM segments WHERE status IN ('active'))"
_WEIGHTS = """SELECT id, place, sum(n * sign)::BIGINT AS weight FROM (SELECT id, n, ('0x' || substr(h, (4 * i + 1)::INT, 2))::BIGINT % 256 AS place, CASE WHEN ('0x' || substr(h, (4 * i + 3)::INT, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS sign
  FROM (SELECT id, n, sha256(token) AS h, unnest(range(0, 16)) AS i FROM (SELECT id, token, count(*) AS n FROM (SELECT id, unnest(CASE WHEN len(x) > 0 THEN x ELSE ['__empty__'] END) AS token
  FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') AS x FROM {texts})) GROUP BY ALL))) GROUP BY ALL HAVING sum(n * sign) <> 0"""
_NEAR = (
    ", sw AS (" + _WEIGHTS.format(texts=f"(SELECT segment_id AS id, text FROM {_TEXTS})") + "), qw AS (" + _WEIGHTS.format(texts=f"(SELECT 'q' AS id, '{QUERY}' AS text)") + ")"
    + ", near AS (SELECT s.segment_id, s.document_id, s.document_type, 1 - coalesce((SELECT sum(a.weight * b.weight) FROM sw a JOIN qw b USING (place) WHERE a.id = s.segment_id), 0) / (sqrt((SELECT sum(weight * weight) FROM sw WHERE id = s.segment_id)) * sqrt((SELECT sum(weight * weight) FROM qw))) AS d"
    + " FROM segments s WHERE s.status IN ('active'))"
)


def _indexed(r: Registry) -> tuple[str, list[dict]]:
    """An index first made of other segments and texts, then brought up to date; and what each sync did."""
    spark = r.claims.sparkSession
    folder = shared.scratch_path(spark, "index")
    old = r.segments.filter("ordinal % 2 = 1").withColumn("text", F.when(F.col("start_char") == 0, "before").otherwise(F.col("text")))
    gone = r.segments.filter("ordinal = 1").withColumn("segment_id", F.concat("segment_id", F.lit(":gone")))
    settings = bundle.merged(bundle.SETTINGS, {"index": {"include_statuses": STATUSES}})
    did = [index.sync(old.unionByName(gone), folder, settings), index.sync(r.segments, folder, settings)]
    return folder, did


@on_registry("idx_sync", f"SELECT s.segment_id, s.document_id, sha256(s.text) AS text_hash, 256::BIGINT AS dims, to_json(s.entity_ids)::VARCHAR AS entity_ids FROM segments s WHERE status IN ('{STATUSES[0]}')")
def _(r: Registry) -> DataFrame:
    folder, _did = _indexed(r)
    rows = index.table(r.claims.sparkSession, folder)
    return rows.select("segment_id", "document_id", "text_hash", F.size("embedding").cast("long").alias("dims"), "entity_ids")


@on_registry(
    "idx_meta",
    """ SELECT (count(*) FILTER (ordinal % 2 = 1) + count(*) FILTER (ordinal = 1))::BIGINT AS first_count, count(*)::BIGINT AS segment_count, (count(*) FILTER (ordinal % 2 = 0 OR start_char = 0))::BIGINT AS embedded,
    (count(*) FILTER (ordinal = 1))::BIGINT AS deleted, 'segments' AS collection_name FROM segments WHERE status IN ('active')""",
)
def _(r: Registry) -> DataFrame:
    folder, (first, second) = _indexed(r)
    meta = index.meta_of(r.claims.sparkSession, folder)
    row = (first["segment_count"], meta["segment_count"], second["embedded"], second["deleted"], meta["collection_name"])
    return r.claims.sparkSession.createDataFrame([row], "first_count long, segment_count long, embedded long, deleted long, collection_name string")


def _asked(r: Registry, **where) -> DataFrame:
    folder, _did = _indexed(r)
    return index.retrieve(r.claims.sparkSession, folder, QUERY, bundle.SETTINGS, **where).select("segment_id", "document_id", F.round("distance", 6).alias("distance"))


@on_registry("ret_query", _NEAR + " SELECT segment_id, document_id, round(d, 6) AS distance FROM near ORDER BY d, segment_id LIMIT 8")
def _(r: Registry) -> DataFrame:
    return _asked(r)


@on_registry("ret_query_filtered", _NEAR + " SELECT segment_id, document_id, round(d, 6) AS distance FROM near WHERE document_type = 'memo' ORDER BY d, segment_id LIMIT 5")
def _(r: Registry) -> DataFrame:
    return _asked(r, document_type="memo", k=5)


_EDITED = """, edited AS (SELECT segment_id, CASE WHEN ordinal % 5 = 3 THEN text || ' more' ELSE text END AS text, CASE WHEN ordinal % 7 = 4 THEN 'changed' ELSE document_type END AS document_type, ordinal % 11 = 6 AS gone FROM segments WHERE status IN ('active')),
edits AS (SELECT count(*) FILTER (gone) AS gone, count(*) FILTER (NOT gone AND ordinal % 5 = 3) AS texts, count(*) FILTER (NOT gone AND ordinal % 5 <> 3 AND ordinal % 7 = 4) AS metadata, count(*) FILTER (NOT gone) AS remain FROM edited JOIN segments USING (segment_id))"""


def _edited(r: Registry) -> tuple[str, dict]:
    """An index of all segments, brought up to date with some that have other texts or types, and some that are gone."""
    spark = r.claims.sparkSession
    folder = shared.scratch_path(spark, "index")
    settings = bundle.merged(bundle.SETTINGS, {"index": {"include_statuses": STATUSES}})
    index.sync(r.segments, folder, settings)
    text = F.when(F.col("ordinal") % 5 == 3, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))
    kind = F.when(F.col("ordinal") % 7 == 4, F.lit("changed")).otherwise(F.col("document_type"))
    return folder, index.sync(r.segments.withColumns({"text": text, "document_type": kind}).filter("ordinal % 11 <> 6"), folder, settings)


@on_registry("idx_delta", _EDITED + " SELECT segment_id, sha256(text) AS text_hash, document_type FROM edited WHERE NOT gone")
def _(r: Registry) -> DataFrame:
    return index.table(r.claims.sparkSession, _edited(r)[0]).select("segment_id", "text_hash", "document_type")


@on_registry("idx_delta_written", _EDITED + " SELECT (gone + texts + metadata)::BIGINT AS written, texts::BIGINT AS embedded, gone::BIGINT AS deleted, remain::BIGINT AS segment_count FROM edits")
def _(r: Registry) -> DataFrame:
    did = _edited(r)[1]
    return r.claims.sparkSession.createDataFrame([tuple(did[c] for c in ("written", "embedded", "deleted", "segment_count"))], "written long, embedded long, deleted long, segment_count long")


_ASKED = "SELECT vec_id AS query, embedding::DOUBLE[] AS probe FROM embeddings WHERE vec_id % 20 = 0"


def _neighbours(spark: SparkSession, sf_dir: str, probes: int | None) -> tuple[DataFrame, DataFrame]:
    """(queries, neighbours) of every vector whose id is divisible by 20, through an index of all; probes 0: through all of its lists."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    folder = shared.scratch_path(spark, "ann")
    meta = ann.build(rows, "vec_id", folder)
    queries = rows.filter("vec_id % 20 = 0").select("vec_id", "embedding")
    return queries, ann.Index(spark, folder).search(queries, "vec_id", probes=meta["lists"] if probes == 0 else probes)


@query("ret_ann_exact")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 0)[1].select("query", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("ret_ann_recall")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many queries there are, and whether an index that looks into some of its lists finds 9 of 10 of their true neighbours."""
    queries, found = _neighbours(spark, sf_dir, None)
    exact = ann.exact(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries, "vec_id")
    hit = exact.join(found.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("reached"))
    return hit


for _space, _sql in (("l2", "list_distance(embedding::DOUBLE[], q) ** 2"), ("ip", "1 - list_inner_product(embedding::DOUBLE[], q)")):

    @query(f"ret_space_{_space}")
    def _(spark: SparkSession, sf_dir: str, space: str = _space) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        probe = list(rows.filter("vec_id = 0").first().embedding)
        return vectors.top_k(rows, probe, "vec_id", space=space).select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"))

    from claimloom.catalog import ORACLES

    ORACLES[f"ret_space_{_space}"] = f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {_sql} AS d FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)) ORDER BY d, vec_id LIMIT 8"

_COSINE = "coalesce(list_inner_product(e.embedding::DOUBLE[], q.probe) / nullif(sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_inner_product(q.probe, q.probe)), 0), 0)"
ORACLES["ret_ann_exact"] = f"SELECT query, vec_id, rank, round(d, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM (SELECT q.query, e.vec_id, 1 - {_COSINE} AS d FROM embeddings e, ({_ASKED}) q)) WHERE rank <= 8"
ORACLES["ret_ann_recall"] = f"SELECT count(*)::BIGINT AS queries, true AS reached FROM ({_ASKED})"
