"""What a review found: queries that read no table, and work that left more on disk or in memory than it needs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from claimloom import catalog
from claimloom.operators import ann, graph, index, report
from claimloom.sources import bundle, shared
from test_catalog import SF, duck
from test_catalog import test_query_agrees_with_its_sql as agrees  # noqa: F401
from test_registry import DOC, registry, root  # noqa: F401

MOVED = ["der_unknown_predicate", "mir_relations", "mir_document_types", "val_document_types_invalid_default_claim_status"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", MOVED)
def test_query_reads_a_given_table(spark, duck, name):  # noqa: F811
    assert catalog.QUERIES[name](spark, SF).inputFiles()
    agrees(spark, duck, name)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize(("name", "table", "rows"), [("lint_drift", "orders", "false"), ("lint_empty", "customer", "c_acctbal >= 0"), ("val_files", "orders", "o_totalprice < 1000")])
def test_findings_on_files_hang_on_the_rows_of_a_table(spark, duck, tmp_path, name, table, rows):  # noqa: F811
    agrees(spark, duck, name)
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", tmp_path / f)
    os.remove(tmp_path / f"{table}.parquet")
    spark.read.parquet(f"{SF}/{table}.parquet").filter(rows).write.parquet(str(tmp_path / f"{table}.parquet"))
    found = [sorted(map(tuple, catalog.QUERIES[name](spark, d).collect())) for d in (SF, str(tmp_path))]
    assert found[0] != found[1]


def folders(spark):
    return set(os.listdir(shared.ensure_checkpoint_dir(spark).removeprefix("file:")))


def test_export_lays_no_second_copy_down(spark, registry, tmp_path, monkeypatch):  # noqa: F811
    before = folders(spark)
    graph.export(registry, str(tmp_path / "graph"))
    assert folders(spark) == before
    read = lambda part, family: [r[0] for r in spark.read.json(f"{tmp_path}/graph/{part}/{family}").select(f"{part[:-1]}_id").collect()]
    assert read("nodes", "claims") == ["claim:c1", "claim:c2"] and read("edges", "claim_evidence") == ["edge.claim_evidence.c1.e1", "edge.claim_evidence.c2.e2"]
    files = os.listdir(f"{tmp_path}/graph/nodes/claims")
    assert any(f.endswith(".json.gz") for f in files) and not any(f.endswith(".json") for f in files)


def test_traversal_leaves_neither_links_nor_shuffles(spark, registry):  # noqa: F811
    links, before = graph.adjacency(registry), folders(spark)
    graph.bfs(links, graph.seeds(registry, "search"), 3)
    assert not [f for f in folders(spark) - before if f.startswith("links")]


def test_written_table_frees_its_shuffles(spark):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    shared.written(spark.range(1000).groupBy(F.col("id") % 7).count(), "t")
    assert held() <= before


def test_folding_sync_writes_no_delta(spark, tmp_path):
    folder = str(tmp_path / "index")
    rows = lambda text: spark.createDataFrame([(f"s{k}", f"{text} {k}", "note", "active") for k in range(10)], "segment_id string, text string, document_type string, status string")
    index.sync(rows("one"), folder, bundle.SETTINGS)
    did = index.sync(rows("two"), folder, bundle.SETTINGS)
    assert did["written"] == 10 and not did["deltas"] and not [f for f in os.listdir(folder) if f.startswith("delta")]
    assert {r.text for r in index.table(spark, folder).collect()} == {f"two {k}" for k in range(10)}


def test_tables_of_the_registry_are_not_read_as_documents(spark, root):  # noqa: F811
    os.makedirs(f"{root}/warehouse/mirror")
    with open(f"{root}/warehouse/mirror/broken.gz", "w") as f:
        f.write("no gzip: reading it fails")
    documents = bundle.load(spark, root).documents
    assert documents.select("text").first()[0] == DOC


def test_report_makes_its_findings_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    found = spark.range(5, numPartitions=1).select(F.lit("error").alias("level"), F.lit("c").alias("code"), F.col("id").cast("string").alias("record"), F.lit("").alias("detail"))
    report.rendered(found.mapInArrow(run, found.schema), "root")
    assert made.value == 5


def test_a_query_goes_to_a_block_of_lists_once(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    vectors = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)], "id long, embedding array<double>")
    meta = ann.build(vectors, "id", str(tmp_path / "a"), "l2", lists=9)
    asked, sent = vectors.filter("id < 40").withColumnRenamed("id", "query"), []
    real = asked.mapInArrow
    monkeypatch.setattr(asked, "mapInArrow", lambda *a: sent.append(real(*a)) or sent[-1], raising=False)
    found = ann.Index(spark, str(tmp_path / "a"))._many(asked, 3, meta["lists"])
    assert sent[0].count() == 40  # 300 rows are one block, whatever the number of lists
    assert found.select("query").distinct().count() == 40
