import random

from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import jaccard, mixing, quality, toxicity

from .helpers import LONG, documents


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(500)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(40, 90))).capitalize() + "." for _ in range(120)]
    rows, labels = [], []
    for i, t in enumerate(base):
        bad = i % 5 == 0
        rows.append((i, t + (" vilest scummy vilely rotten" if bad else ""), "ab"[i % 2]))
        labels.append((i, 1, int(bad)))
    rows += [(1000 + i, base[i] if i % 2 else base[i] + " tail", "b") for i in range(1, 20) if i % 5]
    rows += [(2000, "too short", "a"), (2001, None, "a"), (2002, "### " * 60, None)]
    sf = str(tmp_path)
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    # The same decisions by the plain digests, one operator after the other.
    verdict = {r.doc_id: r.predicted for r in toxicity.score(docs, marks).collect()}
    want = docs.filter(F.col("doc_id").isin([i for i, p in verdict.items() if not p]))
    good = {r.doc_id for r in quality.judge(want).collect() if r.kept}
    want = want.filter(F.col("doc_id").isin(list(good)))
    first = {r.doc_id: r.component_id for r in jaccard.join(want, 5, 80).collect()}
    want = want.filter(F.col("doc_id").isin([i for i, c in first.items() if i == c]))
    got = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        got = stage(spark, got, sf)
        assert got.columns == docs.columns, name
        got.write.parquet(f"{sf}/{name}")
        got = spark.read.parquet(f"{sf}/{name}")
    assert ids(got) == ids(want)
    assert not {i for i, p in verdict.items() if p} & set(ids(got)) and 2000 not in ids(got) and not [i for i in ids(got) if 1000 <= i < 2000 and (i - 1000) % 5]
    plan = mixing.plan_mix(got).collect()
    times = {r.doc_id: r.epochs + int(r.rest > 0 and 2 * r.rest >= r.size) for r in plan}
    mixed = corpus_pipeline.mixed(spark, got, sf)
    assert ids(mixed) == sorted(i for i, n in times.items() for _ in range(n))
    final = corpus_pipeline.run(spark, sf)
    assert ids(final) == ids(mixed) and final.filter("n_tokens = 0 or size(ids) <> n_tokens").count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_cases_of_the_stages(spark, tmp_path):
    names = ["gone", "row", "failed", "pattern", "quality", "__id", "__copy", "times", "cluster", "set_hash"]
    fine = ". ".join(f"Word{i} is number {i} of a long plain tale" for i in range(12))
    rows = [(1, None, None), (2, "", "a"), (3, LONG, "a"), (4, fine, "a"), (5, fine, "b"), (5, fine, "b"), (None, fine + " end", None), (None, None, "a"), (6, fine.replace("tale", "story"), "a")]
    marks = spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for case, part in (("some", rows), ("none", [])):
        sf = str(tmp_path / case)
        documents(spark, part, names).write.parquet(f"{sf}/documents.parquet")
        marks.write.parquet(f"{sf}/labels.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.write.parquet(f"{sf}/{name}")
            docs = spark.read.parquet(f"{sf}/{name}")
            if name == "ngram_jaccard_join" and part:
                assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, LONG), (4, fine), (6, fine.replace("tale", "story"))]
            assert {tuple(r) for r in docs.select(*names).distinct().collect()} <= {("clash",) * len(names)}
        final = corpus_pipeline.STAGES[4][1](spark, docs, sf)
        assert (final.count() > 0) == bool(part) and final.columns == ["doc_id", "source", "n_tokens", "ids"]
