from claimloom.streaming import claims

SCHEMA = "claim_id string, subject_id string, predicate string, object_id string, status string, valid_from string, ord long"
ROWS = [("c1", "a", "depends_on", "b", "accepted", "2025-01-01T00:00:00Z", 1), ("c1", "a", "depends_on", "z", "accepted", "2025-01-02T00:00:00Z", 2), ("c2", "b", "depends_on", "c", "proposed", "2025-01-03T00:00:00Z", 3)]


def test_streams(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    rules = spark.createDataFrame([("back", "depends_on", "dependency_of", "object", "subject", True)], "key string, source_predicate string, derive_predicate string, subject_from string, object_from string, materialize boolean")
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, df in (("edges", claims.derive_stream(stream(), rules)), ("windows", claims.claims_by_window(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "edges" else "complete").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert [r.edge_id for r in spark.table("edges").collect()] == ["edge.back.c1"]
    assert {(r.status, r.n) for r in spark.table("windows").collect()} == {("accepted", 2), ("proposed", 1)}
    claims.keep_latest(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {(r.claim_id, r.object_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("c1", "z"), ("c2", "c")}
