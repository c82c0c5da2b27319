"""Files by Spark's own file systems, so that any store that Spark reads will do; and the folder that cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder: what the cluster names in spark.checkpoint.dir; in local mode one of our own if none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="claimloom-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile stands for its plan: the shuffles behind it go as soon as it is there."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder (zstd Parquet): made once, read as often as it is used."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    with freeing(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._written_at)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return bool(fs.exists(at))


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return bool(fs.exists(at) and fs.getFileStatus(at).isDirectory())


def under(spark: SparkSession, root: str, file: Column) -> Column:
    """A file's path as Spark gives it, seen from the root; without scheme and authority where it is not under it."""
    fs, at = _file(spark, root)
    full = fs.makeQualified(at).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace(file, r"\+", "%2B")), "^[a-z0-9]+:(//[^/]*)?/*", "/")
    return F.when(path.startswith(full + "/"), F.substring(path, F.lit(len(full) + 2), F.length(path))).otherwise(path)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, without byte order mark."""
    fs, at = _file(spark, path)
    stream = fs.open(at)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return bytes(data).decode("utf-8-sig", "replace")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Overwrite a small file, with the folders above it."""
    fs, at = _file(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def display_path(root: str, path: str) -> str:
    """The path as seen from the root; the whole path where it is not under it."""
    root = root.rstrip("/")
    return path[len(root) + 1 :] if path.startswith(root + "/") else path
