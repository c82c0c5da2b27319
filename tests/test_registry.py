"""Operators over a small registry in files, and traps of text and keys."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as fx
from claimloom.operators import dq, graph, index, lint, mirror, report, rules, segment, validate, vectors
from claimloom.sources import bundle, shared

DOC = "# Search service\n\nSearch needs the index.\n\nThe index may need storage.\n"


def claim(i, subject, predicate, object_, status="accepted", review="approved", **more):
    return {
        "claim_id": i, "subject_id": subject, "predicate": predicate, "object_id": object_, "subject_type": "Service", "object_type": "Service", "status": status, "confidence": 0.9, "asserted_by": "agent:x",
        "source_document_id": "d1", "source_segment_id": "seg:d1:001", "review_state": review, "reviewed_by": "human:a", "reviewed_at": "2025-01-01T00:00:00Z", "decision_by": "human:a", "decision_at": "2025-01-01T00:00:00Z", "decision_note": "ok", **more,
    }


def evidence(i, c, s=0, e=20):
    return {"evidence_id": i, "claim_id": c, "source_document_id": "d1", "source_segment_id": "seg:d1:001", "start_char": s, "end_char": e, "evidence_type": "excerpt", "support": "support", "confidence": 0.8, "excerpt": "Search", "captured_by": "agent:x"}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "warehouse" / "jsonl"
    base.mkdir(parents=True)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.md").write_bytes(("﻿" + DOC.replace("\n", "\r\n")).encode())
    put = lambda n, rows: (base / f"{n}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    put("entities", [{"entity_id": f"svc.{n}", "entity_type": "Service", "label": n.title(), "aliases": [n + "-svc"], "status": "active"} for n in ("search", "index", "storage")])
    put("documents", [{"document_id": "d1", "path": "docs/one.md", "document_type": "note", "status": "active", "title": "One"}])
    put("claims", [claim("c1", "svc.search", "depends_on", "svc.index"), claim("c2", "svc.index", "depends_on", "svc.storage", "proposed", "needs_review")])
    put("claim_evidence", [evidence("e1", "c1"), evidence("e2", "c2")])
    (tmp_path / "intelligence" / "manifests").mkdir(parents=True)
    (tmp_path / "intelligence" / "rules").mkdir()
    (tmp_path / "intelligence" / "manifests" / "relations.yaml").write_text("relations:\n- {key: depends_on, label: depends on}\n- {key: dependency_of}\n- {key: depends_on}\n- {label: no key}\n")
    (tmp_path / "intelligence" / "manifests" / "document_types.yaml").write_text("document_types:\n- {key: note, default_claim_status: proposed}\n")
    (tmp_path / "intelligence" / "rules" / "inference.yaml").write_text("rules:\n- {key: back, source_predicate: depends_on, derive_predicate: dependency_of, subject_from: object, object_from: subject}\n")
    return str(tmp_path)


@pytest.fixture
def registry(spark, root):
    r = bundle.load(spark, root)
    links = segment.links(r.claims, r.evidence)
    built = segment.build(r.documents, links)
    return bundle.Registry(**{**r.__dict__, "segments": built, "derived": None})


def test_segments_of_a_short_document(registry):
    rows = registry.segments.collect()
    assert [(r.segment_id, r.start_char, r.end_char, r.text, r.heading_path, r.claim_ids, r.entity_ids, r.tags) for r in rows] == [
        ("seg:d1:001", 0, len(DOC), DOC, ["Search service"], ["c1", "c2"], ["svc.index", "svc.search", "svc.storage"], ["note", "search-service"])
    ]


def test_derivation_validation_projection_and_traversal(spark, registry):
    derived = rules.derive(registry.claims, registry.rules, registry.relations).withColumn("derived_at", F.lit("2025-01-01T00:00:00Z"))
    assert [(r.edge_id, r.subject_id, r.predicate, r.object_id) for r in derived.collect()] == [("edge.back.c1", "svc.index", "dependency_of", "svc.search")]
    r = registry.with_derived(derived)
    assert validate.issues(r).collect() == []
    assert validate.summary(validate.issues(r)).first().status == "passed"
    counts = {x.family: x.n for x in graph.summary(r).collect()}
    assert counts == {"entities": 3, "documents": 1, "segments": 1, "claims": 2, "evidence": 2, "claim_predicates": 1, "derived_relations": 1, "claim_evidence": 2, "evidence_segments": 2, "claim_segments": 2, "segment_documents": 1, "segment_mentions": 3}
    up = {x.measure: (x.direct, x.graph) for x in graph.uplift(r, "svc.search", 3).collect()}
    assert up == {"entities": (2, 3), "claims": (1, 2), "evidence": (1, 2), "segments": (1, 1), "documents": (1, 1)}
    two = {x.measure: x.graph for x in graph.uplift(r, "svc.search", 2).collect()}
    assert two["claims"] == 1 and two["evidence"] == 2
    wrong = derived.select(F.lit("edge.old").alias("edge_id"), F.lit("c2").alias("source_claim_id"), *[c for c in derived.columns if c not in ("edge_id", "source_claim_id")])
    found = validate.issues(r.with_derived(derived.unionByName(wrong)))
    assert [(x.code, x.record) for x in found.collect()] == [("derived.non_accepted_source_claim", "edge.old")]


def test_rule_that_derives_an_undeclared_relation_stops(registry):
    with pytest.raises(ValueError, match="undeclared"):
        rules.derive(registry.claims, registry.rules, registry.relations.filter("key = 'depends_on'"))


def test_no_rules_no_edges(spark, registry):
    assert rules.derive(registry.claims, registry.rules.limit(0)).count() == 0


def test_intervals_that_touch_conflict(spark, registry):
    rows = [claim("x1", "a", "owner", "b", valid_from="2025-01-01T00:00:00Z", valid_to="2025-02-01T00:00:00Z"), claim("x2", "a", "owner", "c", valid_from="2025-02-01T00:00:00Z", valid_to=None), claim("x3", "a", "owner", "d", valid_from="2024-01-01T00:00:00Z", valid_to="2026-02-30T00:00:00Z"), claim("x4", "a", "owner", "b", valid_from="2020-01-01", valid_to="2021-01-01")]
    claims = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", bundle.SCHEMAS["claims"]).alias("r")).select("r.*")
    relations = spark.createDataFrame([("owner", True)], "key string, exclusive_object boolean")
    r = bundle.Registry(**{**registry.__dict__, "claims": claims, "relations": relations})
    assert sorted(map(tuple, validate.exclusive_conflicts(r).collect())) == [("x1", "x2"), ("x1", "x3"), ("x2", "x3")]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    path = tmp_path / "claims.jsonl"
    path.write_text('﻿{"claim_id": "a", "extra": 1}\n\nnot json\n[1]\n{"claim_id": null}\n')
    rows, found = bundle.rows(spark, str(path), bundle.SCHEMAS["claims"])
    assert [r.claim_id for r in rows.orderBy("ord").collect()] == ["a", None]
    assert found.count() == 2
    rows, found = bundle.rows(spark, str(tmp_path / "none.jsonl"), bundle.SCHEMAS["claims"])
    assert rows.count() == 0 and found.first().code == "jsonl.missing"


def test_strict_rows_raise(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundle.rows(spark, str(tmp_path / "none.jsonl"), bundle.SCHEMAS["claims"], strict=True)
    path = tmp_path / "claims.jsonl"
    path.write_text('{"claim_id": "a"}\n[1]\n')
    with pytest.raises(Exception, match="no JSON object"):
        bundle.rows(spark, str(path), bundle.SCHEMAS["claims"], strict=True)[0].collect()


def test_ids_of_other_types_are_found(spark, registry, tmp_path):
    path = tmp_path / "claims.jsonl"
    path.write_text("".join(json.dumps(claim(f"c{k}", "svc.search", "depends_on", "svc.index", source_segment_id=x)) + "\n" for k, x in enumerate([5, ["s"], {}, None, "", "seg:d1:001", "seg:none"])))
    read = bundle.Registry(**{**registry.__dict__, "claims": bundle.rows(spark, str(path), bundle.SCHEMAS["claims"])[0]})
    codes = ["claims.invalid_segment_id", "claims.unknown_segment", "claims.segment_document_mismatch"]
    assert sorted((r.code, r.record) for r in validate.issues(read, codes).collect()) == [("claims.invalid_segment_id", "c0"), ("claims.invalid_segment_id", "c1"), ("claims.invalid_segment_id", "c2"), ("claims.unknown_segment", "c6")]


def test_a_folder_is_checked_whole(spark, root, tmp_path):
    found = report.check(spark, root)[1]
    assert {r.code for r in found.collect()} >= {"mirror.missing", "optional.output_missing", "retrieval.config_missing", "yaml.duplicate_key", "yaml.missing_key"}
    text, status = report.rendered(found, root)
    assert status == 1 and text.startswith(f"Root: {root}\nStatus: failed\nErrors: ") and "- [yaml.missing_key] intelligence/manifests/relations.yaml (relations)" in text
    as_json = json.loads(report.rendered(found, root, as_json=True)[0])
    assert as_json["summary"]["status"] == "failed" and {x["code"] for x in as_json["warnings"]} >= {"mirror.missing", "optional.output_missing"}
    assert report.rendered(found.filter("level = 'warning'"), root)[1] == 0
    # An index file that is no JSON, then one of other segments; a mirror without ledger, with a broken one, with a good one.
    put = lambda path, text: shared.write_text(spark, f"{root}/{path}", text)
    put("warehouse/jsonl/segments.jsonl", json.dumps({"segment_id": "s"}) + "\n")
    segments = bundle.load(spark, root).segments
    assert [c for _, c, _, _ in report.index_issues(spark, root, segments, strict=True)] == ["retrieval.index_missing"]
    put("vector/index/index_meta.json", "{")
    assert [c for _, c, _, _ in report.index_issues(spark, root, segments)] == ["json.parse_failed"]
    put("vector/index/index_meta.json", json.dumps({"segment_source_hash": "old"}))
    assert report.index_issues(spark, root, segments)[0][:2] == ("warning", "retrieval.index_stale")
    put("vector/index/index_meta.json", json.dumps({"segment_source_hash": index.source_hash(segments)}))
    assert report.index_issues(spark, root, segments) == []
    sources = spark.createDataFrame([("claims", "h", 2, "v")], "source_path string, source_hash string, row_count long, schema_version string")
    codes = lambda: [r.code for r in report.mirror_issues(spark, root, sources).collect()]
    put("warehouse/mirror/x", "")
    assert codes() == ["mirror.meta_missing"]
    put("warehouse/mirror/_ledger/part-0.parquet", "no table")
    assert codes() == ["mirror.open_failed"]
    sources.write.mode("overwrite").parquet(f"{root}/warehouse/mirror/_ledger")
    assert codes() == []
    put(bundle.PATHS["settings"], "index: {distance: l2}\n")
    assert bundle.settings(spark, root)["index"] == {**bundle.SETTINGS["index"], "distance": "l2"} and [c for _, c, _, _ in report.optional_issues(spark, root)] == ["optional.output_missing"] * 2
    put(bundle.PATHS["settings"], "- 1\n")
    with pytest.raises(ValueError):
        bundle.settings(spark, root)
    with pytest.raises(FileNotFoundError):
        bundle.settings(spark, str(tmp_path / "nowhere"), required=True)
    assert shared.display_path("/a/b/", "/a/b/c/d") == "c/d" and shared.display_path("/a/b", "/a/bc") == "/a/bc"
    bundle.write_json(spark, {"b": 1, "a": "é"}, f"{root}/x/y.json")
    assert shared.read_text(spark, f"{root}/x/y.json") == '{\n  "a": "é",\n  "b": 1\n}\n'


def test_an_index_is_kept_up_to_date(spark, tmp_path):
    schema = "segment_id string, document_id string, document_type string, status string, text string, claim_ids array<string>, ordinal long"
    of = lambda rows: spark.createDataFrame([(i, "d", "note", s, t, c, 1) for i, s, t, c in rows], schema)
    folder = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.retrieve(spark, folder, "x", bundle.SETTINGS)
    did = index.sync(of([("a", "active", "red fox", ["c1", "c2"]), ("b", "active", "blue sea", None), ("c", "draft", "red sea", None)]), folder, bundle.SETTINGS)
    assert (did["upserted"], did["embedded"], did["deleted"]) == (2, 2, 0)
    did = index.sync(of([("a", "active", "red fox", ["c3"]), ("c", "active", "red sea", None), ("c", "active", "red sea", None)]), folder, bundle.SETTINGS)
    assert (did["upserted"], did["embedded"], did["deleted"]) == (2, 1, 1)
    near = index.retrieve(spark, folder, "the red fox", bundle.SETTINGS).collect()
    assert [r.segment_id for r in near] == ["a", "c"] and near[0].claim_ids == ["c3"] and near[0].distance < near[1].distance
    assert index.retrieve(spark, folder, "red", bundle.SETTINGS, k=1, document_type="none").count() == 0
    did = index.sync(of([("z", "active", "new", None)]), folder, bundle.SETTINGS, reset=True)
    assert (did["upserted"], did["embedded"], did["deleted"]) == (1, 1, 0) and index.meta_of(spark, folder)["segment_count"] == 1


def test_a_remote_provider_asks_in_batches(spark, monkeypatch):
    def send(url, headers, body):
        assert url == "http://e/v1" and headers["Authorization"] == "Bearer key" and body["model"] == "m" and len(body["input"]) <= 2
        return {"data": [{"embedding": [float(len(t)), 1.0]} for t in body["input"]]}

    monkeypatch.delenv("SOME_KEY", raising=False)
    config = {"provider": "remote", "url": "http://e/v1", "model": "m", "api_env": "SOME_KEY", "batch_size": 2}
    with pytest.raises(ValueError, match="SOME_KEY"):
        vectors.provider(config)
    monkeypatch.setenv("SOME_KEY", "key")
    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)] + [(9, None)], "id long, text string")
    got = vectors.remote_provider(config, send)(rows, "id").collect()
    assert {r.id: r.embedding for r in got} == {**{i: [float(i), 1.0] for i in range(5)}, 9: [0.0, 1.0]}
    with pytest.raises(ValueError, match="no embedding provider"):
        vectors.provider({"provider": "other"})


def test_manifest_findings(spark, root):
    rows, found = bundle.manifest(spark, f"{root}/intelligence/manifests/relations.yaml", "relations", bundle.MANIFESTS["relations"])
    assert [r.key for r in rows.collect()] == ["depends_on", "dependency_of"]
    assert found == [("yaml.duplicate_key", "depends_on"), ("yaml.missing_key", "relations")]


def test_text_functions(spark):
    rows = spark.createDataFrame([("  Äb C-d! ",), ("",), (None,), ("--",)], "x string")
    assert [r[0] for r in rows.select(fx.slug(F.col("x"))).collect()] == ["b-c-d", "untitled", "untitled", "untitled"]
    assert rows.select(fx.key_form(F.col("x"))).first()[0] == "äb_c_d!"
    assert [r[0] for r in rows.select(fx.tokens(F.col("x"))).collect()] == [["b", "c", "d"], ["__empty__"], ["__empty__"], ["__empty__"]]
    assert rows.select(fx.moment(F.lit("2026-02-30T00:00:00Z"))).first()[0] is None
    assert bundle.merged({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}, "d": 3}


def test_offsets_are_code_points(spark):
    text = "é😀 x\n# Head\nbody 😀\n## Sub\nmore\n# Next\n"
    d = spark.createDataFrame([("d", text)], "document_id string, text string")
    lines = {r.line: (r.start_char, r.line_text) for r in segment.lines(d).collect()}
    assert lines[2] == (5, "# Head") and len(lines) == 6
    got = [(text[r.start_char : r.end_char], r.heading_path) for r in segment.sections(d).orderBy("start_char").collect()]
    assert got == [("é😀 x\n", []), ("# Head\nbody 😀\n", ["Head"]), ("## Sub\nmore\n", ["Head", "Sub"]), ("# Next\n", ["Next"])]


def test_packing_covers_the_text_and_keeps_to_the_size():
    text = "\n\n".join("w" * n for n in (10, 20, 100, 5, 5)) + "\n"
    spans = segment.pack_section(text, 0, len(text), 40, 10)
    assert spans == [(0, 32), (34, 74), (64, 104), (94, 134), (136, 149)]
    assert list(segment._slide(0, 5, 2, 9)) == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_windows_match_the_loop(spark):
    d = spark.createDataFrame([(str(n), "a" * n) for n in (0, 1, 1200, 1201, 2250, 2251, 9999)], "document_id string, text string")
    got = {}
    for r in segment.windows(d).collect():
        got.setdefault(r.document_id, []).append((r.start_char, r.end_char))
    assert got == {str(n): list(segment._slide(0, n, 1200, 150)) for n in (1, 1200, 1201, 2250, 2251, 9999)}


def test_underlined_titles(spark):
    d = spark.createDataFrame([("d", "Title\n=====\ntext\nSub\n---\nno\n--\nLong\n####\n")], "document_id string, text string")
    assert [(r.level, r.title) for r in segment.underlined_headings(d).orderBy("start_char").collect()] == [(1, "Title"), (2, "Sub"), (2, "no"), (11, "Long")]


def test_keys(spark):
    d = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4), ("b", 5)], "k string, ord long")
    assert sorted(map(tuple, dq.first_by_key(d, "k", ["ord"]).collect())) == [("a", 1), ("b", 5)]
    assert sorted(map(tuple, dq.duplicate_keys(d, "k").collect())) == [("a", 1)]
    assert dq.missing_keys(d, "k").count() == 2


def test_embedding_matches_its_definition(spark):
    import hashlib
    import math

    texts = ["Index the index", "", None, "日本"]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.embedding for r in vectors.embed(d, "id").collect()}
    for i, t in enumerate(texts):
        import re

        v = [0.0] * 256
        for w in re.findall("[a-z0-9_]+", (t or "").lower()) or ["__empty__"]:
            h = hashlib.sha256(w.encode()).digest()
            for place, sign in zip(h[::2], h[1::2], strict=True):
                v[place] += 1 - 2 * (sign % 2)
        n = math.sqrt(sum(x * x for x in v)) or 1
        assert got[i] == pytest.approx([x / n for x in v])
    near = vectors.top_k(vectors.embed(d, "id"), got[0], "id", 1).first()
    assert near.id == 0 and abs(near.distance) < 1e-9


def test_mirror_and_its_freshness(spark, registry, tmp_path):
    derived = rules.derive(registry.claims, registry.rules)
    r = registry.with_derived(derived)
    ledger = mirror.sync(r, str(tmp_path / "m"))
    assert validate.mirror_issues(ledger, mirror.state(r)).count() == 0
    # Other content of an equal count.
    other = dataclasses.replace(r, claims=r.claims.withColumn("decision_note", F.when(F.col("claim_id") == "c1", "looked at again").otherwise(F.col("decision_note"))))
    assert [x.record for x in validate.mirror_issues(ledger, mirror.state(other)).collect()] == ["claims"]
    where = ledger.filter("source_path = 'claims'").first().location
    assert json.loads(spark.read.parquet(where).orderBy("claim_id").first().payload_json)["claim_id"] == "c1"
    assert validate.index_issues(None, "h", True) == [("error", "retrieval.index_missing")] and validate.index_issues("a", "b") == [("warning", "retrieval.index_stale")] and validate.index_issues("a", "a") == []


def test_lint(spark, tmp_path):
    put = lambda p, t: ((tmp_path / p).parent.mkdir(parents=True, exist_ok=True), (tmp_path / p).write_text(t))
    put("docs/README.md", "- Status: Active\n- Source of Truth: Yes\n\nSee `docs/GONE.md`, `docs/CURRENT_STATE.md` and `https://x.y/z.md`.\n")
    put("docs/CURRENT_STATE.md", "---\nstatus: active\nsource_of_truth: maybe\n---\n## Current Truth\nnothing\n")
    put("docs/archive/old.md", "Status: Archived\n")
    put("pyproject.toml", '[project.scripts]\nrun-it = "pkg.cli:main"\n')
    put("pkg/cli.py", "from pkg.legacy_io import read\n\ndef main():\n    pass\n")
    put("pkg/legacy_io.py", "def read(): ...\n")
    put("intelligence/manifests/actions.yaml", "actions:\n- {key: a, status: implemented, capability: c2, touches_datasets: [d], implementation: 'pkg.cli:other'}\n")
    put("intelligence/registry/capabilities.yaml", "capabilities:\n- {key: c1, status: active, implementation: 'pkg.cli:main'}\n- {key: c3, status: active, implementation: pkg.cli}\n")
    put("intelligence/handlers/h.yaml", "emitted_by: [a, b]\nchain: [{action: a}, {reason: x}, 5]\n")
    put("changed.txt", "pkg\\cli.py\n\n")
    found = sorted((r.code, r.record) for r in lint.lint(spark, str(tmp_path), str(tmp_path / "changed.txt")).collect())
    assert [c for c, _ in found if c != "docs.optional_missing"] == [
        "actions.capability_unknown", "actions.datasets_registry_missing", "docs.archive_banner_missing", "docs.broken_reference", "docs.current_state_missing_console_script", "docs.invalid_source_of_truth",
        "docs.legacy_runtime_dependency_missing", "drift.current_state_missing", "drift.docs_sync_missing", "handlers.invalid_step", "handlers.missing_action", "handlers.unknown_emitter",
        "impl.invalid_format", "impl.symbol_missing", "intelligence.datasets_missing", "intelligence.glossary_missing",
    ]
    assert sum(c == "docs.optional_missing" for c, _ in found) == 5
    assert lint.lint(spark, str(tmp_path / "nowhere")).first().code == "repo.missing"


def test_segmentation_stays_in_the_row(spark):
    """Nulls, empty texts and repeated ids are cut row by row, without a shuffle."""
    text = "intro\r\n# A\nx\n\n \n## B 😀\ny\n\n\n# C\n"
    rows = [("d", text), ("d", "\n# Z\n"), ("n", None), ("e", ""), (None, "# only"), ("w", "a\n\nb\n")]
    d = spark.createDataFrame(rows, "document_id string, text string")
    plain = text.replace("\r\n", "\n")
    got = sorted((r.document_id or "", r.line, r.start_char, r.line_text) for r in segment.lines(d).collect())
    want = []
    for key, body in rows:
        at = 0
        cut = (body or "").replace("\r\n", "\n").split("\n")
        for n, line in enumerate(cut):
            if n + 1 < len(cut) or line:
                want.append((key or "", n + 1, at, line))
            at += len(line) + 1
    assert got == sorted(want)
    heads = [(r.document_id, r.level, r.title, r.start_char) for r in segment.headings(d).collect()]
    assert heads == [("d", 1, "A", 6), ("d", 2, "B 😀", 15), ("d", 1, "C", plain.index("# C")), ("d", 1, "Z", 1), (None, 1, "only", 0)]
    parts = [(r.document_id, r.start_char, r.end_char) for r in segment.paragraphs(d).collect() if r.document_id == "w"]
    assert parts == [("w", 0, 1), ("w", 3, 5)]
    paths = [r.heading_path for r in segment.sections(d.limit(1)).orderBy("start_char").collect()]
    assert paths == [[], ["A"], ["A", "B 😀"], ["C"]]
    full = d.selectExpr("document_id", "'note' document_type", "'accepted' status", "text", "'a.md' path")
    assert sorted(r.text for r in segment.build(full).collect() if r.document_id == "d" and r.text.strip() == "# Z") == ["# Z\n"]
    for df in (segment.lines(d), segment.headings(d), segment.underlined_headings(d), segment.sections(d), segment.paragraphs(d), segment.build(full)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert segment.build(full.limit(0)).count() == 0
