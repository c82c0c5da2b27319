"""What the training-data operators share: words, shared-folder tables, table access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode else one of our own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="claimloom-")
        atexit.register(shutil.rmtree, found, True)
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables that cut lineage: written to the shared folder, read again, dropped when consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, tag: str = "t", by: str | None = None) -> DataFrame:
        """Write df once (in a folder for each value of a column, if one is named) and return a reader over the files (zstd Parquet)."""
        self.count += 1
        path, conf = f"{self.root}/{self.count:03d}-{tag}", self.spark.conf
        before = conf.get(_CLEANUP)
        conf.set(_CLEANUP, "true")  # the table stands for its plan from here on: the shuffles behind it can go
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame, part: str = "") -> None:
        """Delete the files of tables, or a part of them (column=value), that nothing reads any more."""
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{df._scratch_path}/{part}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name like this one that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows and bytes of an Arrow batch: a worker holds a few batches, so its memory does not hang on the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20) + "b", BATCH_BYTES)}


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and idle ones count against their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in small batches (unless the session has sizes of its own); a task leaves no memory behind."""
    spark = df.sparkSession
    for key, (default, ours) in _DEFAULTS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(over, schema)


def bytes_of(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a binary or string Arrow column, without decoding."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the fold of a row. A null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def lower_ascii(b: bytes) -> bytes:
    """A-Z to a-z and nothing else (bytes.lower is ASCII only)."""
    return b.lower()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the words seen so far, up to a bound on memory."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def batch_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hashes of the different words of a column of texts (A-Z lower-cased, null: none), all words as places among
    them, and where each text's begin and end.

    Arrow splits and numbers the words; only the different ones of the batch are hashed one by one.
    """
    held = pc.fill_null(texts.view(pa.string()) if pa.types.is_binary(texts.type) else texts.cast(pa.string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(held))
    flat = parts.flatten()
    solid = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty part
    ends = np.append(0, np.cumsum(np.asarray(solid), dtype=np.int64))[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
    words = flat.filter(solid).view(pa.binary()).dictionary_encode()
    different = words.dictionary.to_numpy(zero_copy_only=False)  # bytes, several times as fast as to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, different), np.uint64, len(different)), words.indices.to_numpy(), ends


def batch_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a column of texts, and where each text's begin and end."""
    of, places, ends = batch_words(texts)
    return (of[places] if len(of) else of), ends
