"""Linting a repository's documents and contracts: dangling references, missing parts, drift.

Files are one DataFrame (path, text); manifests are small and come parsed. Each rule is a DataFrame
of findings (level, code, record, detail), as in validation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions.text import truth_form
from claimloom.operators.dq import dangling, issue
from claimloom.operators.lint_text import metadata, references, section
from claimloom.sources import shared
from claimloom.sources.bundle import load_yaml

# Expected documents, required metadata and sections, hints, entry points.
DOCUMENTS = ["README.md", "CURRENT_STATE.md", "ARCHITECTURE.md", "LAYERS.md", "SKILLS_INTEGRATION.md", "ROADMAP.md", "IMPACT_SUMMARY.md"]
METADATA_NAMES = ["status", "source_of_truth"]
IMPACT_SECTIONS = {"changed": ["## changed"], "checked not changed": ["## checked not changed", "## checked-not-changed", "## checked but did not need changes"], "remaining drift": ["## remaining drift"], "validator summary": ["## validator summary"]}
BANNER, BANNER_LINES = ["Status: Archived", "Source of Truth: No"], 8
LEGACY_HINTS = ["intentional legacy", "transitional", "still live", "still imported", "runtime dependency", "legacy support"]
NEGATIONS = ["none recorded", "not recorded", "not clearly", "does not clearly", "not yet"]
ENTRY_POINTS = ["cli.py", "main.py", "serve.py", "server.py", "app.py"]
MANIFEST_FILES = {"glossary": ("intelligence/glossary.yaml", "terms", "term"), "actions": ("intelligence/manifests/actions.yaml", "actions", "key"), "entities": ("intelligence/manifests/entities.yaml", "entities", "key"), "datasets": ("intelligence/manifests/datasets.yaml", "datasets", "dataset_key"), "capabilities": ("intelligence/registry/capabilities.yaml", "capabilities", "key")}


@dataclass
class Repository:
    """A repository's files, and its manifests by key."""

    spark: SparkSession
    root: str
    files: DataFrame
    manifests: dict[str, dict[str, dict] | None] = field(default_factory=dict)
    handlers: list[tuple[str, dict]] = field(default_factory=list)
    found: list[tuple[str, str, str, str]] = field(default_factory=list)

    def table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def exists(self, path: str) -> bool:
        return shared.exists(self.spark, f"{self.root}/{path}")


def open_repository(spark: SparkSession, root: str) -> Repository:
    root = root.rstrip("/")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(shared.under(spark, root, F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    repo = Repository(spark, root, files)
    for kind, (path, part, key) in MANIFEST_FILES.items():
        repo.manifests[kind] = _keyed(repo, path, part, key) if repo.exists(path) else None
    handlers = files.filter(F.col("path").startswith("intelligence/handlers/") & F.col("path").endswith(".yaml")).select("path").orderBy("path").collect()
    for r in handlers:
        data = _parsed(repo, r.path)
        if isinstance(data, dict):
            repo.handlers.append((r.path, data))
    return repo


def _parsed(repo: Repository, path: str) -> object:
    try:
        return load_yaml(repo.spark, f"{repo.root}/{path}")
    except ImportError:
        repo.found.append(("error", "yaml.missing_dependency", path, ""))
    except Exception as e:  # noqa: BLE001  what a broken file raises is the parser's affair
        repo.found.append(("error", "yaml.parse_failed", path, str(e)[:200]))
    return None


def _keyed(repo: Repository, path: str, part: str, key: str) -> dict[str, dict]:
    data = _parsed(repo, path)
    out: dict[str, dict] = {}
    note = lambda code, detail="": repo.found.append(("error", f"yaml.{code}", path, detail))
    if data is None:
        return out
    if not isinstance(data, dict):
        note("invalid_root")
    elif part not in data:
        note("missing_section", part)
    elif not isinstance(data[part] or [], list):
        note("invalid_section", part)
    else:
        for x in data[part] or []:
            if not isinstance(x, dict):
                note("invalid_item", str(x)[:80])
            elif not x.get(key):
                note("missing_key", part)
            elif str(x[key]) in out:
                note("duplicate_key", str(x[key]))
            else:
                out[str(x[key])] = x
    return out


def _has(text, words: list[str]):
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def docs_issues(repo: Repository) -> DataFrame:
    """Missing documents, metadata, references, banners, sections."""
    if not repo.exists("docs"):
        return issue(repo.table([("docs",)], "p string"), "warning", "docs.missing", F.col("p"))
    listed = repo.table([(f"docs/{n}",) for n in DOCUMENTS], "path string")
    current = repo.files.join(F.broadcast(listed), "path", "left_semi")
    out = issue(listed.join(repo.files, "path", "left_anti"), "warning", "docs.optional_missing", F.col("path"))
    facts = metadata(current).filter(F.col("name").isin(METADATA_NAMES)).groupBy("path").pivot("name", METADATA_NAMES).agg(F.first("value"))
    facts = current.select("path").join(facts, "path", "left")
    lost = F.array_compact(F.array(*(F.when(F.col(n).isNull(), n) for n in METADATA_NAMES)))
    out = out.unionByName(issue(facts.filter(F.size(lost) > 0), "error", "docs.missing_metadata", F.col("path"), F.array_join(lost, ", ")))
    odd = facts.filter(F.col("status").isNotNull() & ~truth_form(F.col("source_of_truth")).isin("yes", "no"))
    out = out.unionByName(issue(odd, "error", "docs.invalid_source_of_truth", F.col("path")))
    named = references(current).filter(~F.col("reference").contains(":") | F.col("reference").rlike("^(docs/|intelligence/|scripts/|AGENTS\\.md)"))
    paths = repo.files.select("path").unionByName(repo.files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("path"))).distinct()
    broken = named.withColumn("target", F.regexp_replace(F.regexp_replace("reference", "^\\./", ""), "/+$", "")).join(paths.withColumnRenamed("path", "target"), "target", "left_anti")
    out = out.unionByName(issue(broken, "error", "docs.broken_reference", F.col("path"), F.col("reference")))
    top = F.array_join(F.slice(F.split("text", "\n"), 1, BANNER_LINES), "\n")
    bare = repo.files.filter(F.col("path").startswith("docs/archive/") & F.col("path").endswith(".md") & ~(top.contains(BANNER[0]) & top.contains(BANNER[1])))
    out = out.unionByName(issue(bare, "error", "docs.archive_banner_missing", F.col("path")))
    low = F.lower("text")
    parts = F.array_compact(F.array(*(F.when(~_has(low, options), name) for name, options in IMPACT_SECTIONS.items())))
    summary = current.filter("path = 'docs/IMPACT_SUMMARY.md'").withColumn("lost", parts).filter(F.size("lost") > 0)
    return out.unionByName(issue(summary, "error", "docs.impact_summary_incomplete", F.col("path"), F.array_join("lost", ", "))).unionByName(visibility_issues(repo))


def modules(files: DataFrame) -> DataFrame:
    """module, file: dotted names that files answer to; of several the first in order of place."""
    rows = files.filter(F.col("path").endswith(".py"))
    stem = F.regexp_replace("path", r"\.py$", "")
    options = []
    for nth, (prefix, suffix) in enumerate((("", ""), ("", "/__init__"), ("src/", ""), ("src/", "/__init__"))):
        fits = stem.startswith(prefix) & stem.endswith(suffix) if prefix or suffix else F.lit(True)
        name = F.translate(F.regexp_replace(F.regexp_replace(stem, f"^{prefix}", ""), f"{suffix}$", ""), "/", ".")
        options.append(F.when(fits, F.struct(name.alias("module"), F.lit(nth).alias("nth"))))
    flat = rows.select("path", F.explode(F.array_compact(F.array(*options))).alias("o"))
    return flat.groupBy(F.col("o.module").alias("module")).agg(F.min_by("path", F.col("o.nth")).alias("file"))


def legacy_imports(files: DataFrame) -> DataFrame:
    """file: modules of the repository named legacy that its code imports."""
    code = files.filter(F.col("path").endswith(".py") & ~F.col("path").rlike(r"(^|/)\."))
    found = F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+([A-Za-z0-9_\.]+)\s+import\s+"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([A-Za-z0-9_\.]+)"), F.lit(1)))
    named = code.select(F.explode(found).alias("module")).filter(F.lower("module").contains("legacy")).distinct()
    return named.join(modules(files), "module").select("file").distinct()


def console_scripts(files: DataFrame) -> DataFrame:
    """name, target of [project.scripts]."""
    part = F.regexp_extract("text", r"(?m)^\[project\.scripts\]\s*$([\s\S]*?)(?=^\[|\z)", 1)
    line = files.filter("path = 'pyproject.toml'").select(F.explode(F.split(part, "\n")).alias("line")).select(F.trim("line").alias("line")).filter("line <> '' and line not like '#%' and line like '%=%'")
    return line.select(F.trim(F.split("line", "=", 2)[0]).alias("name"), F.regexp_replace(F.trim(F.split("line", "=", 2)[1]), "^[\"']+|[\"']+$", "").alias("target"))


def visibility_issues(repo: Repository) -> DataFrame:
    """Console scripts and live legacy modules that the document of the current state does not show."""
    state = repo.files.filter("path = 'docs/CURRENT_STATE.md'").select(F.lower("text").alias("state"), F.lower(F.concat_ws("\n", section(F.col("text"), "Transitional Facts"), section(F.col("text"), "Current Truth"))).alias("shown"))
    scripts = console_scripts(repo.files).withColumn("module", F.split("target", ":")[0]).join(modules(repo.files), "module", "left")
    # One row of text against a handful of names.
    both = scripts.join(F.broadcast(state), F.lit(True))
    unseen = both.filter(~F.col("state").contains(F.lower("name")) & ~F.col("state").contains(F.lower("target")) & ~F.coalesce(F.col("state").contains(F.lower("file")), F.lit(False)))
    names = unseen.agg(F.array_sort(F.collect_list("name")).alias("names")).filter(F.size("names") > 0)
    out = issue(names, "warning", "docs.current_state_missing_console_script", F.lit("docs/CURRENT_STATE.md"), F.array_join("names", ", "))
    live = legacy_imports(repo.files).join(F.broadcast(state), F.lit(True))
    hidden = live.filter(~F.col("shown").contains(F.lower("file")) | ~_has(F.col("shown"), LEGACY_HINTS) | _has(F.col("shown"), NEGATIONS))
    files = hidden.agg(F.array_sort(F.collect_list(F.lower("file"))).alias("files")).filter(F.size("files") > 0)
    return out.unionByName(issue(files, "warning", "docs.legacy_runtime_dependency_missing", F.lit("docs/CURRENT_STATE.md"), F.array_join("files", ", ")))


def implementation_issues(repo: Repository, links: DataFrame) -> DataFrame:
    """Findings on links (path, link) such as package.module:function."""
    out = issue(links.filter("coalesce(link, '') = ''"), "error", "impl.missing", F.col("path"))
    given = links.filter("link <> ''")
    out = out.unionByName(issue(given.filter("link not like '%:%'"), "error", "impl.invalid_format", F.col("path"), F.col("link")))
    split = given.filter("link like '%:%'").withColumns({"module": F.split("link", ":", 2)[0], "symbol": F.split("link", ":", 2)[1]}).join(modules(repo.files), "module", "left")
    out = out.unionByName(issue(split.filter("file is null"), "error", "impl.unresolved", F.col("path"), F.col("link")))
    read = split.filter("file is not null").join(repo.files.select(F.col("path").alias("file"), "text"), "file")
    defined = F.expr(r"text rlike concat('(async\\s+def|def)\\s+\\Q', symbol, '\\E\\s*\\(')")
    return out.unionByName(issue(read.filter(~defined), "error", "impl.symbol_missing", F.col("path"), F.col("link")))


def contract_issues(repo: Repository) -> DataFrame:
    """Findings on glossary, manifests and handlers: references are anti-joins of exploded lists."""
    if not repo.exists("intelligence"):
        return issue(repo.table([("intelligence",)], "p string"), "warning", "intelligence.missing", F.col("p"))
    m, path = repo.manifests, {k: v[0] for k, v in MANIFEST_FILES.items()}
    found = [("warning", f"intelligence.{k}_missing", path[k], "") for k in ("glossary", "actions", "datasets", "capabilities") if m[k] is None]
    keys = {k: list(v or {}) for k, v in m.items()}
    for term, x in (m["glossary"] or {}).items():
        if str(x.get("status", "")).lower() == "deprecated" and not (x.get("replaced_by") or x.get("aliases") or x.get("related_terms")):
            found.append(("error", "glossary.deprecated_unmapped", path["glossary"], term))
    for key, x in (m["actions"] or {}).items():
        if str(x.get("status", "")).lower() == "implemented" and not x.get("capability"):
            found.append(("error", "actions.missing_capability", path["actions"], key))
        if x.get("capability") and not keys["capabilities"]:
            found.append(("error", "actions.capability_registry_missing", path["actions"], key))
        if x.get("touches_datasets") and not keys["datasets"]:
            found.append(("error", "actions.datasets_registry_missing", path["actions"], key))
    for key, x in (m["datasets"] or {}).items():
        if x.get("canonical_shape") and not repo.exists(str(x["canonical_shape"])):
            found.append(("error", "datasets.canonical_shape_missing", path["datasets"], key))
    for file, data in repo.handlers:
        for step in data.get("chain") or []:
            if not isinstance(step, dict):
                found.append(("error", "handlers.invalid_step", file, ""))
            elif not step.get("action"):
                found.append(("error", "handlers.missing_action", file, ""))
    # Lists of references: (code, where, who, what), and what they may name.
    named = [("actions.capability_unknown", path["actions"], k, str(x["capability"]), "capabilities") for k, x in (m["actions"] or {}).items() if x.get("capability")]
    for code, kind, column, of in (("actions.dataset_unknown", "actions", "touches_datasets", "datasets"), ("entities.unknown_term", "entities", "canonical_terms", "glossary"), ("entities.unknown_action", "entities", "used_by_actions", "actions"), ("datasets.unknown_action", "datasets", "used_by_actions", "actions")):
        named += [(code, path[kind], k, str(v), of) for k, x in (m[kind] or {}).items() for v in x.get(column) or []]
    for file, data in repo.handlers:
        used = [("handlers.unknown_emitter", str(v)) for v in data.get("emitted_by") or []] + [("handlers.unknown_action", str(s["action"])) for s in data.get("chain") or [] if isinstance(s, dict) and s.get("action")]
        if keys["actions"]:
            named += [(code, file, "", v, "actions") for code, v in used]
        else:
            found += [("error", "handlers.actions_missing", file, v) for _, v in used]
    references_ = repo.table([x for x in named if keys[x[4]]], "code string, path string, record string, ref string, of string")
    known = repo.table([(k, v) for k, vs in keys.items() for v in vs], "of string, ref string")
    lost = references_.join(known, ["of", "ref"], "left_anti").select(F.lit("error").alias("level"), "code", F.col("path").alias("record"), F.concat_ws(" -> ", "record", "ref").alias("detail"))
    links = [(path["capabilities"], x.get("implementation")) for x in (m["capabilities"] or {}).values() if str(x.get("status", "")).lower() in ("active", "implemented")]
    links += [(path["actions"], x["implementation"]) for x in (m["actions"] or {}).values() if x.get("implementation")]
    out = repo.table([*found, *repo.found], "level string, code string, record string, detail string").unionByName(lost)
    return out.unionByName(implementation_issues(repo, repo.table([(p, str(v) if v else None) for p, v in links], "path string, link string")))


def drift_issues(repo: Repository, changed: str | None) -> DataFrame:
    """Findings on a list of changed files, one a line: what should have changed with them."""
    one = lambda code, where="": issue(repo.table([(where,)], "p string"), "warning", code, F.col("p"))
    if changed is None:
        return one("drift.changed_files_missing")
    if not shared.exists(repo.spark, changed):
        return one("drift.changed_files_not_found", changed)
    rows = repo.spark.read.text(changed).select(F.translate(F.trim("value"), "\\", "/").alias("p")).filter("p <> ''")
    docs = F.col("p").rlike("^(docs|intelligence)/")
    entry = F.col("p").rlike("^(scripts|bin)/")
    for n in ENTRY_POINTS:
        entry = entry | F.col("p").endswith(n)
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), any_(docs | (F.col("p") == "AGENTS.md")).alias("docs"), any_(F.col("p").rlike(r"\.(py|sql|yaml|yml)$") & ~docs).alias("code"), any_(entry).alias("entry"),
        any_(F.col("p") == "docs/CURRENT_STATE.md").alias("state"), any_(F.col("p") == "intelligence/manifests/actions.yaml").alias("actions"), any_(F.col("p") == "intelligence/registry/capabilities.yaml").alias("capabilities"),
        any_(F.col("p").startswith("intelligence/handlers/")).alias("handlers"),
    )
    rules = {"drift.changed_files_empty": "n = 0", "drift.docs_sync_missing": "code and not docs", "drift.current_state_missing": "entry and not state", "drift.capability_sync_missing": "actions and not capabilities", "drift.handler_sync_missing": "handlers and not actions"}
    found = F.array_compact(F.array(*(F.when(F.expr(rule), code) for code, rule in rules.items())))
    return facts.select(F.explode(found).alias("code")).select(F.lit("warning").alias("level"), "code", F.lit("").alias("record"), F.lit("").alias("detail"))


def lint(spark: SparkSession, root: str, changed: str | None = None) -> DataFrame:
    """All findings on a repository."""
    if not shared.is_folder(spark, root):
        code = "repo.invalid" if shared.exists(spark, root) else "repo.missing"
        return spark.createDataFrame([("error", code, root, "")], "level string, code string, record string, detail string")
    repo = open_repository(spark, root)
    return docs_issues(repo).unionByName(contract_issues(repo)).unionByName(drift_issues(repo, changed))
