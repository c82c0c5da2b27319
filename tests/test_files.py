"""Files: fingerprints that do not hang on how they are cut, and rows in the files' order."""

import random

import pytest

from claimloom.operators import dq
from claimloom.sources import bundle, fingerprint


def prints(spark, root, paths, cut=None):
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, cut or before)
        return {r.source_path: r.source_hash for r in fingerprint.of_sources(spark, str(root), paths).collect()}
    finally:
        spark.conf.set(key, before)


def by_definition(*files):
    pair = (0, 0)
    for data in files:
        lines = data.split(b"\n")
        for line in lines[:-1] if lines[-1] == b"" else lines:
            pair = fingerprint.joined(pair, fingerprint.of_line(line))
    return f"{sum(map(len, files))}:{pair[0]}:{pair[1]:032x}"


def test_fingerprints_equal_their_definition_however_files_are_cut(spark, tmp_path):
    rng = random.Random(7)
    big = b"".join(b"%d %s\r\n" % (i, bytes(rng.randrange(32, 256) for _ in range(rng.randrange(90)))) for i in range(4000)) + b"end"
    files = {"big": big, "empty": b"", "bare": b"x", "ended": b"x\n", "blank": b"\n\n", "odd name +%20é": b"a\nb\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder/b").mkdir(parents=True)
    (tmp_path / "folder/a.jsonl").write_bytes(b"1\n2\n")
    (tmp_path / "folder/b/c.jsonl").write_bytes(big)
    paths = {n: n for n in [*files, "folder", "gone"]}
    want = {n: by_definition(d) for n, d in files.items()} | {"folder": by_definition(b"1\n2\n", big)}
    for cut in (None, "20000b", "1000b"):
        assert prints(spark, tmp_path, paths, cut) == want
    assert len(set(want.values())) == len(want)
    # Two lines change places; one byte changes.
    lines = big.split(b"\n")
    lines[5], lines[3000] = lines[3000], lines[5]
    for other in (b"\n".join(lines), big[:-2] + b"xd"):
        (tmp_path / "big").write_bytes(other)
        assert prints(spark, tmp_path, {"big": "big"})["big"] not in (want["big"], None)
    assert prints(spark, tmp_path, {"gone": "gone"}) == {}


def test_the_first_row_of_a_key_is_that_of_the_first_file(spark, tmp_path):
    # The later file is larger, so that Spark deals it out first, and in several cuts.
    (tmp_path / "claims.jsonl").mkdir()
    (tmp_path / "claims.jsonl/part-0.jsonl").write_text("".join('{"claim_id": "c%d", "status": "first"}\n' % i for i in range(0, 3000, 2)))
    (tmp_path / "claims.jsonl/part-1.jsonl").write_text("".join('{"claim_id": "c%d", "status": "%s"}\n' % (i % 3000, "second" if i < 3000 else "third") for i in range(9000)))
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(key, "30000b")
        rows = bundle.rows(spark, str(tmp_path / "claims.jsonl"), bundle.SCHEMAS["claims"])[0]
        assert rows.rdd.getNumPartitions() > 3
        got = {r.claim_id: r.status for r in dq.first_by_key(rows, "claim_id", ["ord"]).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {f"c{i}": "second" if i % 2 else "first" for i in range(3000)}


def test_folders_are_resolved_and_must_be_there(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "docs/a/x.md"), ("d2", "docs/b/y.md"), ("d3", "docsy/z.md")], "document_id string, path string")
    (tmp_path / "docs").mkdir()
    got = lambda *a: [r.document_id for r in bundle.within(docs, *a).orderBy("document_id").collect()]
    assert got("docs") == got("/docs/./", str(tmp_path)) == got("docsy/../docs") == ["d1", "d2"]
    assert got("") == got(".") == ["d1", "d2", "d3"]
    for outside in ("..", "docs/../../x", "../docs"):
        with pytest.raises(ValueError):
            bundle.within(docs, outside)
    with pytest.raises(FileNotFoundError):
        bundle.within(docs, "gone", str(tmp_path))
