"""Fingerprints of files of any size: hashed in parts by many tasks, and put together in order.

A file is read as lines. Of a run of lines the fingerprint is the pair (number, sum of d_i * B^(n-1-i) modulo
a prime), d_i being a line's SHA-256; two runs side by side give that of both. So the cuts that Spark makes in a
file do not show in the result, a task holds one line at a time, and what is put together on one worker is a
pair for each cut. With the sizes of the files, which tell of a missing line end at the end, this stands
for the content: a chance in 2^127 that a change goes unseen, though no proof against one who makes changes to that end.

A folder counts as its files in order of their names below it, joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.sources import shared

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"line").digest()[:15], "big")


def joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The pair of two runs of lines, one after the other."""
    return a[0] + b[0], (a[1] * pow(BASE, b[0], PRIME) + b[1]) % PRIME


def of_line(line: bytes) -> tuple[int, int]:
    return 1, int.from_bytes(hashlib.sha256(line).digest()[:16], "big") % PRIME


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pair for each cut of a file, from its lines in order."""
    now, n, value = None, 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, n, f"{value:x}")], ["file", "size", "start", "lines", "value"])

    for batch in batches:
        for line, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "size", "start")), strict=True):
            if at != now:
                if now:
                    yield out()
                now, n, value = at, 0, 0
            n, value = n + 1, (value * BASE + of_line(line)[1]) % PRIME
    if now:
        yield out()


def _whole(table: pa.Table) -> pa.Table:
    """name, source_hash of a source, from the pairs of its files' cuts."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["file"], r["start"]))
    pair = (0, 0)
    for r in rows:
        pair = joined(pair, (r["lines"], int(r["value"], 16)))
    size = sum({r["file"]: r["size"] for r in rows}.values())
    return pa.table({"source_path": [rows[0]["source_path"]], "source_hash": [f"{size}:{pair[0]}:{pair[1]:032x}"]})


def of_sources(spark: SparkSession, root: str, paths: Mapping[str, str]) -> DataFrame:
    """source_path (the source's name), source_hash of every source that is there; paths: by name, a file or folder under the root."""
    there = {n: p for n, p in paths.items() if shared.exists(spark, f"{root}/{p}")}
    names = spark.createDataFrame([(n,) for n in there], "source_path string")
    if not there:
        return names.withColumn("source_hash", F.lit(None).cast("string"))
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text([f"{root}/{p}" for p in there.values()])
    lines = lines.select(F.col("value").cast("binary"), meta("file_path").alias("file"), meta("file_size").alias("size"), meta("file_block_start").alias("start"))
    runs = lines.mapInArrow(_runs, "file string, size long, start long, lines long, value string")
    file, name = shared.under(spark, root, F.col("file")), F.lit(None).cast("string")
    for n, p in there.items():
        name = F.when((file == p) | file.startswith(f"{p}/"), n).otherwise(name)
    found = runs.withColumn("source_path", name).groupBy("source_path").applyInArrow(_whole, "source_path string, source_hash string")
    return names.join(found, "source_path", "left").withColumn("source_hash", F.coalesce("source_hash", F.lit(f"0:0:{0:032x}")))
