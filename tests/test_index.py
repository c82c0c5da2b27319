"""The index of segments: deltas, versions, filters; and the vector index."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from claimloom.operators import ann, index, vectors
from claimloom.sources import bundle

SEGMENTS = "segment_id string, status string, text string, claim_ids array<string>, document_type string"


def segments(spark, rows):
    return spark.createDataFrame(rows, SEGMENTS)


def held(spark, folder):
    return {r.segment_id: (r.text, r.text_hash, r.claim_ids, r.status, r.document_type, tuple(r.embedding)) for r in index.table(spark, folder).collect()}


def size_of(folder, part):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{folder}/{part}") for f in names if f.endswith(".parquet"))


def words(rng, n=12):
    return " ".join(rng.choice(["red", "fox", "blue", "sea", "index", "search", "claim", "graph"]) + str(rng.randrange(50)) for _ in range(n))


def test_a_small_change_writes_little_and_readers_go_on(spark, tmp_path):
    rng, folder = random.Random(1), str(tmp_path / "index")
    rows = [[f"s{i}", "active", words(rng), ["c"], "memo"] for i in range(3000)]
    first = index.sync(segments(spark, rows), folder, bundle.SETTINGS)
    reader, before = index.table(spark, folder), held(spark, folder)
    for row in rows[:30]:
        row[2] = words(rng)
    did = index.sync(segments(spark, rows), folder, bundle.SETTINGS)
    assert (did["written"], did["embedded"], did["segment_count"], did["base"]) == (30, 30, 3000, first["base"])
    assert size_of(folder, did["deltas"][0]) < 0.1 * size_of(folder, did["base"])  # files' footers count
    assert index.sync(segments(spark, rows), folder, bundle.SETTINGS)["deltas"] == did["deltas"]  # nothing changed, nothing written
    # A reader of the first version reads it on, through syncs that make a new base of everything.
    for row in rows:
        row[2] += " more"
    did = index.sync(segments(spark, rows), folder, bundle.SETTINGS)
    assert did["base"] != first["base"] and not did["deltas"] and set(did["retired"]) >= {first["base"]}
    assert {r.segment_id: r.text for r in reader.collect()} == {k: v[0] for k, v in before.items()}
    did = index.sync(segments(spark, rows[1:]), folder, bundle.SETTINGS, keep=0)
    assert not did["retired"] and not os.path.exists(f"{folder}/{first['base']}") and os.path.exists(f"{folder}/{did['base']}")
    assert set(held(spark, folder)) == {r[0] for r in rows[1:]}


def test_deltas_add_up_to_a_fresh_index(spark, tmp_path, monkeypatch):
    rng, folder = random.Random(2), str(tmp_path / "index")
    monkeypatch.setattr(index, "MAX_DELTAS", 2)
    state = {f"s{i}": ["active", words(rng), [f"c{i}"], rng.choice(["memo", "note", "", None])] for i in range(200)}
    bases = set()
    for _ in range(4):
        for k in rng.sample(sorted(state), 6):
            kind = rng.randrange(4)
            if kind == 0:
                del state[k]
            else:
                state[k] = [state[k][0], words(rng) if kind == 1 else state[k][1], state[k][2] + ["x"] if kind == 2 else state[k][2], rng.choice(["memo", "note", "", None]) if kind == 3 else state[k][3]]
        state[f"n{rng.randrange(10**6)}"] = ["active", words(rng), None, "memo"]
        rows = segments(spark, [(k, s, t, c, d) for k, (s, t, c, d) in state.items()])
        bases.add(index.sync(rows, folder, bundle.SETTINGS)["base"])
        assert index.meta_of(spark, folder)["segment_count"] == len(state)
        index.sync(rows, str(tmp_path / "fresh"), bundle.SETTINGS, reset=True)
        assert held(spark, folder) == held(spark, str(tmp_path / "fresh"))
        for kind in ("memo", "none"):
            assert {r.segment_id for r in index.table(spark, folder, {"document_type": kind}).collect()} == {k for k, v in state.items() if v[3] == kind}
    assert len(bases) == 2
    # Other metadata: rows are written anew, vectors stay.
    fewer = bundle.merged(bundle.SETTINGS, {})
    fewer["metadata_fields"] = ["segment_id", "status"]
    did = index.sync(rows, folder, fewer)
    assert did["embedded"] == 0 and "claim_ids" not in index.table(spark, folder).columns and did["segment_count"] == len(state)


def test_filters_skip_folders(spark, tmp_path):
    folder = str(tmp_path / "index")
    index.sync(segments(spark, [(f"s{i}", "active", f"text {i}", None, f"type{i % 9}") for i in range(90)]), folder, bundle.SETTINGS)
    found = index.table(spark, folder, {"document_type": "type3"})
    plan = found._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(bucket" in plan.toString()
    assert found.count() == 10
    near = index.retrieve(spark, folder, "text 12", bundle.SETTINGS, k=3, document_type="type3").collect()
    assert near[0].segment_id == "s12" and {r.document_type for r in near} == {"type3"}


def test_asking_the_vector_index_equals_the_scan(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "index")
    rows = [[f"s{i}", rng.choice(["active", "archived"]), words(rng), ["c"], rng.choice(["memo", "note"])] for i in range(400)]
    rows += [[f"copy{i}", "active", "red fox", None, "memo"] for i in range(150)]
    index.sync(segments(spark, rows), folder, bundle.SETTINGS)
    meta = index.build_ann(spark, folder, lists=12)
    for row in rows[:20]:
        row[2] = "red fox blue sea"
    for row in rows[400:420]:
        row[2] = "other"
    did = index.sync(segments(spark, rows[:540]), folder, bundle.SETTINGS)
    assert did["ann"] == meta["ann"] and did["deltas"]
    for text, where in (("red fox", {}), ("red1 fox2 sea3", {"document_type": "note"}), ("index4 search5", {"document_type": "memo", "status": "archived"}), ("graph", {"document_type": "none"})):
        ask = lambda **o: [(r.segment_id, round(r.distance, 9)) for r in index.retrieve(spark, folder, text, bundle.SETTINGS, k=7, **where, **o).collect()]  # noqa: B023, E731
        assert ask(approximate=True, probes=12) == ask()
    assert len(index.retrieve(spark, folder, "red1", bundle.SETTINGS, approximate=True).collect()) == 8


# --- the vector index by itself ---


def brute(rows, queries, k, space):
    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        if space == "l2":
            return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        if space == "ip":
            return 1 - dot
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 1 - (dot / n if n else 0)

    return {q: sorted((round(distance(v, p), 9), i) for i, v in rows)[:k] for q, p in queries}


def table_of(spark, rows, extra=()):
    return spark.createDataFrame([*rows, *extra], "id string, embedding array<double>").withColumns({"list": F.lit(1), "rep": F.lit("clash"), "key": F.lit(0)})


def answers(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.query, []).append((round(r.distance, 9), r.key))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
def test_with_all_lists_probed_the_search_is_exact(spark, tmp_path, monkeypatch, space):
    rng = random.Random(4)
    rows = [(f"v{i:03}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(250)] + [(f"w{i:03}", [1.0, 2.0, 0.0, 0.0, 0.0, -1.0]) for i in range(120)] + [("zero", [0.0] * 6), ("far", [300.0] * 6)]
    odd = [("null", None), ("short", [1.0]), ("nan", [math.nan] + [0.0] * 5), (None, [0.0] * 6), ("hole", [None] + [0.0] * 5)]
    queries = [("a", [0.9, 2.1, 0.0, 0.0, 0.0, -1.0]), ("b", [0.0] * 6), *[(f"q{i}", [rng.gauss(0, 1) for _ in range(6)]) for i in range(12)]]
    ann.build(table_of(spark, rows, odd), "id", str(tmp_path / "a"), space, lists=9)
    found = ann.Index(spark, str(tmp_path / "a"))
    assert found.vectors == 253  # copies are one row
    want = brute(rows, queries, 10, space)
    few = answers(found.search(table_of(spark, queries, odd), "id", 10, probes=9))
    monkeypatch.setattr(ann, "FEW", 3)
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    many = answers(found.search(table_of(spark, queries, odd), "id", 10, probes=9))
    assert few == many == want


def test_probing_some_lists_reads_some_files_and_finds_most(spark, tmp_path):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(25)]
    rows = [(f"v{i}", [m + rng.gauss(0, 0.35) for m in middles[i % 25]]) for i in range(2000)]
    meta = ann.build(table_of(spark, rows), "id", str(tmp_path / "a"), "l2")
    found = ann.Index(spark, str(tmp_path / "a"))
    queries = [r for r in rows if int(r[0][1:]) % 20 == 0]
    want = brute(rows, queries, 8, "l2")
    got = answers(found.search(table_of(spark, queries), "id"))
    recall = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / (8 * len(want))
    assert recall >= 0.9 and meta["probes"] < meta["lists"] / 2
    assert meta["recall"] == sorted(meta["recall"]) and meta["recall"][-1] == 1

    def files(numbers):
        rows = found.of_lists(numbers).select("rep")
        rows.collect()
        return rows._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()

    read = [files(range(n)) for n in (1, 5, 20, meta["lists"])]
    assert read == sorted(set(read)) and read[0] <= 2


def test_vector_indexes_of_little(spark, tmp_path):
    ann.build(table_of(spark, []), "id", str(tmp_path / "none"))
    assert ann.Index(spark, str(tmp_path / "none")).search(table_of(spark, [("a", [1.0])]), "id").count() == 0
    ann.build(table_of(spark, [("x", [1.0, 0.0])] * 3), "id", str(tmp_path / "one"))
    one = ann.Index(spark, str(tmp_path / "one"))
    assert [(r.key, r.rank) for r in one.search(table_of(spark, [("a", [1.0, 1.0])]), "id").orderBy("rank").collect()] == [("x", 1), ("x", 2), ("x", 3)]
    assert one.search(table_of(spark, []), "id").count() == 0
    with pytest.raises(ValueError):
        one.search(table_of(spark, []), "id", 101)
    assert answers(ann.exact(table_of(spark, [("x", [1.0, 0.0]), ("y", [0.0, 1.0])]), table_of(spark, [("a", [0.0, 2.0])]), "id", 1)) == {"a": [(0.0, "y")]}


def test_codes_and_losses():
    import numpy as np

    rng = np.random.default_rng(6)
    rest = rng.normal(size=(50, 9)) * rng.choice([1e-9, 1, 1e6], (50, 1))
    rest[0] = 0
    code, scale, loss = ann.encoded(rest)
    assert np.allclose(np.sqrt(((rest - code * scale[:, None].astype(float)) ** 2).sum(1)), loss) and (loss <= np.abs(rest).max(1) / 127 * 0.51 * 3 + 1e-12).all()
    assert vectors.TOP_K == 8
