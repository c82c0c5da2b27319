"""Hash embeddings, index maintenance and top-k retrieval by cosine distance.

The hash embedding is a function of one text, so one pass over Arrow batches makes it and no row moves:
the 32 bytes of each token's digest are read as 16 (place, sign) pairs; a token is digested once a batch.
The sparse form holds the places that are not 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from claimloom.functions.text import decode_list, tokens

DIMENSIONS, TOP_K, PAIRS = 256, 8, 16
#: Rows whose places are added up at once.
BATCH = 500
# Metadata that an index keeps of a segment.
METADATA = ["segment_id", "document_id", "document_type", "status", "entity_ids", "claim_ids", "tags"]


class _Places(dict):
    """token -> the places and signs that its digest names, remembered for the tokens of a task up to a bound."""

    LIMIT = 100_000

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self) >= self.LIMIT:
            self.clear()
        digest = np.frombuffer(hashlib.sha256(token.encode()).digest(), np.uint8).reshape(PAIRS, 2)
        self[token] = found = digest[:, 0].astype(np.int64) % self.dimensions, np.where(digest[:, 1] % 2 == 0, 1, -1)
        return found


def _weights(lists: pa.ListArray, places: _Places) -> np.ndarray:
    """Row by place: the signs of all tokens of a row added up."""
    out = np.zeros((len(lists), places.dimensions), np.int64)
    words = lists.flatten().dictionary_encode()
    if len(words):
        at, sign = (np.array(x) for x in zip(*(places[t] for t in words.dictionary.to_pylist()), strict=True))
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        of = words.indices.to_numpy()
        for k in range(PAIRS):  # one pair of every token at a time, so that no table is PAIRS times the tokens
            np.add.at(out, (row, at[of, k]), sign[of, k])
    return out


def _tokenised(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(key, tokens(F.col(text)).alias("tokens"))


def sparse(rows: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """key, place, weight of the places whose signs do not cancel out (not normalised), for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimensions)
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                found = _weights(part.column("tokens"), places)
                row, place = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(place), pa.array(found[row, place])], [key, "place", "weight"])

    slim = _tokenised(rows, key, text)
    return slim.mapInArrow(run, StructType([slim.schema[key], *StructType.fromDDL("place long, weight long")]))


def embed(rows: DataFrame, key: str, text: str = "text", dimensions: int = DIMENSIONS, keep: Sequence[str] = ()) -> DataFrame:
    """key, embedding of each row: array of double of unit length; all zeros if every place cancels out. keep: columns that stay between the two."""
    kept = [c for c in keep if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(dimensions)
        for batch in batches:
            for part in (batch.slice(k, BATCH) for k in range(0, batch.num_rows, BATCH)):
                found = _weights(part.column("tokens"), places)
                norm = np.sqrt((found * found).sum(1))
                dense = found / np.where(norm > 0, norm, 1)[:, None]
                offsets = pa.array(np.arange(len(found) + 1) * dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(part.column(c) for c in kept), pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))], [key, *kept, "embedding"])

    slim = rows.select(key, *kept, tokens(F.col(text)).alias("tokens"))
    return slim.mapInArrow(run, StructType([*(slim.schema[c] for c in (key, *kept)), StructField("embedding", ArrayType(DoubleType()))]))


def remote_provider(config: dict, send: Callable[[str, dict, dict], dict] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """Vectors from a service: config names its url, model and the environment variable of its key; texts go in batches.

    send(url, headers, body) returns the answer, {"data": [{"embedding": [...]}, ...]} in order of body["input"].
    """
    import os

    name = config.get("api_env", "EMBEDDING_API_KEY")
    token = os.environ.get(name)
    if send is None and not token:
        raise ValueError(f"the environment variable {name} is not set")
    url, model, size, call = config["url"], config["model"], int(config.get("batch_size", 64)), send or _post

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                answer = call(url, {"Authorization": f"Bearer {token}"}, {"model": model, "input": [t or "" for t in part.column("text").to_pylist()]})
                found = [x["embedding"] for x in answer["data"]]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.float64()))], [batch.schema.names[0], "embedding"])

    def embedded(rows: DataFrame, key: str) -> DataFrame:
        slim = rows.select(key, "text")
        return slim.mapInArrow(run, StructType([slim.schema[key], StructField("embedding", ArrayType(DoubleType()))]))

    return embedded


def _post(url: str, headers: dict, body: dict) -> dict:
    import json
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {**headers, "Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.load(answer)


def hash_provider(dimensions: int = DIMENSIONS) -> Callable[[DataFrame, str], DataFrame]:
    return lambda rows, key: embed(rows, key, dimensions=dimensions)


def provider(config: dict) -> Callable[[DataFrame, str], DataFrame]:
    """The embedding step that a configuration names; others are given as functions of the same form."""
    kind = config.get("provider", "hash")
    if callable(kind):
        return kind
    if kind == "hash":
        return hash_provider(int(config.get("dimensions", DIMENSIONS)))
    if kind == "remote":
        return remote_provider(config)
    raise ValueError(f"no embedding provider {kind!r} here")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; 1 if either vector is 0."""
    return 1 - F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def distance(a: Column, b: Column, space: str = "cosine") -> Column:
    """cosine: 1 - cos; l2: the squared Euclidean distance; ip: 1 - the inner product."""
    if space == "cosine":
        return cosine_distance(a, b)
    if space == "ip":
        return 1 - dot(a, b)
    if space == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"no distance {space!r}")


def top_k(index: DataFrame, query: list[float], key: str, k: int = TOP_K, where: dict[str, str] | None = None, space: str = "cosine") -> DataFrame:
    """The k nearest rows with their distance, ties by key; filters are applied before."""
    rows = index
    for column, value in (where or {}).items():
        rows = rows.filter(F.col(column) == value)
    vector = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", distance(F.col("embedding"), vector, space)).orderBy("distance", key).limit(k or TOP_K)


def index_rows(segments: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """What an index holds: text and metadata of segments in the given states, of all without states."""
    rows = segments.filter(F.col("status").isin(statuses)) if statuses else segments
    return rows.select("segment_id", "text", *(c for c in METADATA if c in rows.columns and c != "segment_id"))


def sync_plan(segments: DataFrame, indexed: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """segment_id, action: what brings the index up to date (upsert or delete)."""
    current = index_rows(segments, statuses).select("segment_id").distinct()
    return current.withColumn("action", F.lit("upsert")).unionByName(stale(indexed, current).withColumn("action", F.lit("delete")))


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    return indexed.select("segment_id").distinct().join(current.select("segment_id"), "segment_id", "left_anti")


def decoded(results: DataFrame) -> DataFrame:
    """Results with list-valued metadata read back from the text it is kept as."""
    return results.withColumns({c: decode_list(F.col(c)) for c in ("heading_path", "claim_ids", "entity_ids", "tags") if dict(results.dtypes).get(c) == "string"})
