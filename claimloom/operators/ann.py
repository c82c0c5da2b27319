"""Nearest neighbours through inverted lists: an index of vectors in files, searched in part or whole.

Vectors are first laid so that the Euclidean distance orders them as the space does (laid()). Coarse
centroids, trained by Spark's k-means on a bounded sample, cut them into lists, one Parquet partition each.
A row holds its distance from the centroid in one byte a component, the byte's scale, and the length of
what that loses. A search reads the codes of the nearest lists only (probes): code and loss give an
interval for every distance, and what may belong to the k nearest by it is measured exactly, from
the vectors of those rows alone. With all lists probed the result is that of an exact scan.

Equal vectors are one row of the index, under their least key, and their keys a table beside it, the first `most`
of them, which is all that a search for up to so many neighbours can ask for: copies do not crowd out candidates.

A few queries travel with the code to the files; many are dealt to blocks of lists, once a block however
many of its lists they look into, in parts, so that a task's memory does not hang on the number or size of lists.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from claimloom.operators import vectors
from claimloom.sources import shared

META = "ann_meta.json"
#: Lists at most, and vectors for each that k-means sees at most. A search that asks for more neighbours than MOST scans exactly.
LISTS, SAMPLE_PER_LIST, MOST = 16_384, 64, 100
#: Up to so many queries travel with the code. Codes of a block of lists and queries that meet in one task, and distances that it holds at once.
FEW, BLOCK, QUERY_BLOCK, CELLS = 1000, 20_000, 2_000, 1 << 20
#: Parts into which the copies of a vector are dealt before the first of them are taken.
SALTS = 256
#: Vectors that are searched for exactly after a build, to learn how many lists a search has to look into for a recall.
PROBED, RECALL = 200, 0.95
_SLACK = 1e-6


def laid(x: np.ndarray, space: str, longest: float, query: bool = False) -> np.ndarray:
    """Rows in a space whose Euclidean distance orders them as the distance of `space` does.

    cosine: unit vectors; a zero vector is as far from all as a right angle, as an indexed row or as a query.
    ip: rows get a component that brings them to one length, queries none.
    """
    if space == "l2":
        return x
    if space == "ip":
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, more[:, None]], 1)
    length = np.sqrt((x * x).sum(1))
    return np.concatenate([x / np.where(length > 0, length, 1)[:, None], (0.0 if query else 1.0) * (length == 0)[:, None]], 1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def encoded(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, losses) of residuals: one byte a component, and the length of what it leaves."""
    scale = (np.abs(rest).max(1) / 127).astype(np.float32)
    steps = np.where(scale > 0, scale, 1).astype(np.float64)[:, None]
    code = np.clip(np.rint(rest / steps), -127, 127)
    return code.astype(np.int8), scale, np.sqrt(((rest - code * steps) ** 2).sum(1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _fitting(rows: DataFrame, key: str, dimensions: int) -> DataFrame:
    """Rows whose vector has the index's length and finite components: others have no distance."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.select(F.col(key).alias("key"), "embedding").filter(F.coalesce((F.size("embedding") == dimensions) & finite, F.lit(False)) & F.col("key").isNotNull())


def build(rows: DataFrame, key: str, folder: str, space: str = "cosine", lists: int | None = None, most: int = MOST, recall: float = RECALL, seed: int = 1) -> dict:
    """Write the index of rows (key, embedding) to a folder; returns what META says of it.

    META's probes is the least number of lists that finds the share `recall` of the true neighbours of PROBED indexed vectors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    first = rows.filter("size(embedding) > 0").select(F.size("embedding")).first()
    dimensions = first[0] if first else 0
    salted = _fitting(rows, key, dimensions).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    early = salted.withColumn("nth", F.row_number().over(Window.partitionBy("embedding", "salt").orderBy("key"))).filter(F.col("nth") <= most)
    copies = Window.partitionBy("embedding").orderBy("key")
    named = early.withColumns({"nth": F.row_number().over(copies), "rep": F.first("key").over(copies)}).filter(F.col("nth") <= most)
    named = shared.written(named.select("rep", "key", "nth", F.when(F.col("nth") == 1, F.col("embedding")).alias("embedding")), "ann")
    distinct = named.filter("nth = 1").select("rep", "embedding")
    norm = F.sqrt(vectors.dot(F.col("embedding"), F.col("embedding")))
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(norm)).first()
    longest = float(longest or 0) * (1 + 1e-9)
    wanted = max(1, min(lists or math.ceil(math.sqrt(n)), LISTS, n or 1))

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = laid(_matrix(batch.column("embedding")), space, longest)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["x"])

    centroids = np.zeros((1, dimensions + (space != "l2")))
    if n:
        share = min(1.0, wanted * SAMPLE_PER_LIST / n)
        drawn = distinct.filter(F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1) if share < 1 else distinct
        points = shared.written(drawn.select("embedding").mapInArrow(coordinates, "x array<double>"), "ann-sample").select(array_to_vector("x").alias("x"))
        fitted = KMeans(k=wanted, seed=seed, maxIter=10, featuresCol="x").fit(points) if wanted > 1 else None
        centroids = np.array(fitted.clusterCenters()) if fitted else centroids

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = laid(_matrix(batch.column("embedding")), space, longest)
            of = np.concatenate([squared(x[k : k + 512], centroids).argmin(1) for k in range(0, len(x), 512)] or [np.empty(0, np.int64)])
            code, scale, loss = encoded(x - centroids[of])
            columns = [batch.column("rep"), pa.array(of, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float32()), pa.array(loss, pa.float64()), batch.column("embedding")]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "list", "code", "scale", "loss", "embedding"])

    held = StructType([distinct.schema["rep"], *StructType.fromDDL("list int, code binary, scale float, loss double"), distinct.schema["embedding"]])
    out = distinct.mapInArrow(placed, held).hint("rebalance", "list").sortWithinPartitions("list", "rep")
    out.write.option("compression", "zstd").partitionBy("list").parquet(f"{folder}/lists")
    repeated = F.max("nth").over(Window.partitionBy("rep")) > 1
    named.select("rep", "key", "nth", repeated.alias("repeated")).filter("repeated").select("rep", "key", "nth").write.parquet(f"{folder}/copies")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "list int, x array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    fields = StructType([f for f in held.fields if f.name != "list"] + [held["list"]])
    meta = {"space": space, "dimensions": dimensions, "longest": longest, "lists": len(centroids), "vectors": n, "most": most, "schema": fields.json(), "probes": len(centroids)}
    put = lambda: shared.write_text(spark, f"{folder}/{META}", json.dumps(meta, indent=2, sort_keys=True) + "\n")
    put()
    meta["recall"] = Index(spark, folder).calibrated(seed)
    meta["probes"] = next((p for p, found in enumerate(meta["recall"], 1) if found >= recall), len(centroids))
    put()
    return meta


class Index:
    """An index in a folder: its centroids in memory (LISTS at most), its lists as a table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        meta = json.loads(shared.read_text(spark, f"{folder}/{META}"))
        self.space, self.dimensions, self.longest, self.most, self.vectors, self.probes = (meta[k] for k in ("space", "dimensions", "longest", "most", "vectors", "probes"))
        schema = StructType.fromJson(json.loads(meta["schema"]))
        self.lists = spark.read.schema(schema).parquet(f"{folder}/lists") if meta["vectors"] else spark.createDataFrame([], schema)
        self.centroids = np.array([r.x for r in spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()])
        kind = schema["rep"].dataType
        self.copies = spark.read.schema(StructType([StructField("rep", kind), StructField("key", kind), *StructType.fromDDL("nth int")])).parquet(f"{folder}/copies")

    def nearest_lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Of laid queries, the numbers of the lists to look into."""
        return np.argsort(squared(x, self.centroids), 1, kind="stable")[:, : max(1, probes)]

    def of_lists(self, numbers: Sequence[int]) -> DataFrame:
        """The rows of some lists: other lists' files are not read."""
        return self.lists.filter(F.col("list").isin([int(k) for k in numbers])) if len(numbers) < len(self.centroids) else self.lists

    def search(self, queries: DataFrame, key: str, k: int = vectors.TOP_K, probes: int | None = None) -> DataFrame:
        """query, key, distance, rank: the k nearest rows to each query (key, embedding), ties by key; k up to `most`.

        probes: lists that a query looks into; by default what the build found to be enough.
        """
        if not 1 <= k <= self.most:
            raise ValueError(f"k is {k}; this index answers 1 to {self.most}")
        asked = _fitting(queries, key, self.dimensions).withColumnRenamed("key", "query")
        few, probes = asked.limit(FEW + 1).collect(), probes or self.probes
        found = self._few(few, k, probes) if len(few) <= FEW else self._many(asked, k, probes)
        reps = self._measured(found, asked, k)
        keys = reps.join(self.copies.filter(F.col("nth") <= k), "rep", "left").select("query", F.coalesce("key", "rep").alias("key"), "distance")
        return keys.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).filter(F.col("rank") <= k)

    def calibrated(self, seed: int = 1, k: int = vectors.TOP_K) -> list[float]:
        """The recall of a search of 1, 2, ... lists, over the k nearest of PROBED indexed vectors: where these lie in the order of lists."""
        drawn = self.lists.select(F.col("rep").alias("query"), "embedding").orderBy(F.xxhash64("rep", F.lit(seed))).limit(PROBED)
        asked = drawn.collect()
        if not asked:
            return [1.0]
        x = laid(np.array([r.embedding for r in asked], dtype=np.float64), self.space, self.longest, query=True)
        place = {r.query: np.argsort(order) for r, order in zip(asked, self.nearest_lists(x, len(self.centroids)), strict=True)}
        kind = self.lists.schema
        again = self.spark.createDataFrame([tuple(r) for r in asked], StructType([StructField("query", kind["rep"].dataType), kind["embedding"]]))
        near = self._measured(self._few(asked, k, len(self.centroids)), again, k).select("query", "list").collect()  # PROBED * k rows
        ranks = np.array([place[r.query][r.list] for r in near])
        return [float((ranks < p).mean()) for p in range(1, len(self.centroids) + 1)]

    def _screen(self, k: int):
        """Of rows and the queries that look into their lists (looks: query by list), what may be among the k nearest: (place of the query, place of the row, low, high)."""
        centroids = self.centroids

        def screen(x: np.ndarray, looks: np.ndarray, rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
            of = rows.column("list").to_numpy()
            scales, losses = (rows.column(c).to_numpy().astype(np.float64) for c in ("scale", "loss"))
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(of), -1)
            near = centroids[of] + code * scales[:, None]
            step, found = max(1, CELLS // max(1, len(of))), []
            for at in range(0, len(x), step):
                part = x[at : at + step]
                d = np.sqrt(squared(part, near))
                # The subtraction in squared() loses digits of close points; the slack is far above that.
                slack = _SLACK * (1 + np.sqrt((part * part).sum(1))[:, None])
                low, high = d - losses - slack, d + losses + slack
                seen = looks[at : at + step][:, of]
                high[~seen] = np.inf
                bound = np.partition(high, k - 1, 1)[:, k - 1 : k] if high.shape[1] > k else np.full((len(part), 1), np.inf)
                q, r = np.nonzero((low <= bound) & seen)
                found.append((q + at, r, low[q, r], high[q, r]))
            return tuple(np.concatenate(c) for c in zip(*found, strict=True))

        return screen

    def _looks(self):
        """Of laid queries, whether each looks into each list."""
        centroids = self.centroids

        def looks(x: np.ndarray, probes: int) -> np.ndarray:
            out = np.ones((len(x), len(centroids)), bool)
            if probes < len(centroids):
                for at in range(0, len(x), 512):
                    out[at : at + 512] = False
                    np.put_along_axis(out[at : at + 512], np.argsort(squared(x[at : at + 512], centroids), 1, kind="stable")[:, : max(1, probes)], True, 1)
            return out

        return looks

    def _few(self, asked: list, k: int, probes: int) -> DataFrame:
        """query, rep, list, low, high, the queries being with the code."""
        names = [r.query for r in asked]
        x = laid(np.array([r.embedding for r in asked], dtype=np.float64).reshape(len(asked), self.dimensions), self.space, self.longest, query=True)
        looks = self._looks()(x, probes) if len(asked) else np.zeros((0, len(self.centroids)), bool)
        screen, kind = self._screen(k), self.lists.schema["rep"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(x) or not batch.num_rows:
                    continue
                q, r, low, high = screen(x, looks, batch)
                rows = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), batch.column("rep").take(rows), batch.column("list").take(rows), pa.array(low), pa.array(high)], ["nth", "rep", "list", "low", "high"])

        schema = StructType([*StructType.fromDDL("nth int"), StructField("rep", kind), *StructType.fromDDL("list int, low double, high double")])
        numbers = self.spark.createDataFrame(list(enumerate(names)), StructType([*StructType.fromDDL("nth int"), StructField("query", kind)]))
        found = self.of_lists(np.flatnonzero(looks.any(0)).tolist()).select("rep", "list", "code", "scale", "loss").mapInArrow(run, schema)
        return found.join(F.broadcast(numbers), "nth").drop("nth")  # FEW rows at most

    def _many(self, asked: DataFrame, k: int, probes: int) -> DataFrame:
        """The same for any number of queries: a query goes once to each block of lists that has one of its lists."""
        space, longest, kind = self.space, self.longest, self.lists.schema["rep"].dataType
        screen, looks = self._screen(k), self._looks()
        # Lists one after another make a block, up to BLOCK rows; a longer list makes several. (list, its first block, how many): a row a list.
        places, last, held = [], 0, 0
        for r in sorted(self.lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()):
            if held and held + r.n > BLOCK:
                last, held = last + 1, 0
            parts = -(-r.n // BLOCK)
            places.append((r.list, last, parts))
            last, held = (last + parts, 0) if parts > 1 else (last, held + r.n)
        blocks = np.zeros((len(self.centroids), last + 1), bool)
        for number, first, n in places:
            blocks[number, first : first + n] = True
        parts = max(1, -(-asked.count() // QUERY_BLOCK))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = max(1, CELLS // max(blocks.shape) // 16)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = laid(_matrix(part.column("embedding")), space, longest, query=True)
                    rows, block = np.nonzero(looks(x, probes) @ blocks)
                    yield pa.RecordBatch.from_arrays([part.column("query").take(pa.array(rows)), pa.array(block, pa.int32()), pa.array([x[r].tobytes() for r in rows], pa.binary())], ["query", "block", "x"])

        probing = asked.mapInArrow(dealt, StructType([StructField("query", kind), *StructType.fromDDL("block int, x binary")]))
        right = probing.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int"))
        sizes = self.spark.createDataFrame(places, "list int, first int, blocks int")
        left = self.lists.select("list", "rep", "code", "scale", "loss").join(F.broadcast(sizes), "list")  # LISTS rows at most
        block = (F.col("first") + F.pmod(F.xxhash64("rep"), "blocks")).cast("int").alias("block")
        left = left.select("list", "rep", "code", "scale", "loss", block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

        def meet(codes: pa.Table, asks: pa.Table) -> pa.Table:
            names = ["query", "rep", "list", "low", "high"]
            if not len(codes) or not len(asks):
                return pa.Table.from_arrays([asks.column("query").slice(0, 0), codes.column("rep").slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()), pa.array([], pa.float64())], names)
            x = np.frombuffer(b"".join(asks.column("x").to_pylist()), np.float64).reshape(len(asks), -1)
            q, r, low, high = screen(x, looks(x, probes), codes)
            rows = pa.array(r)
            return pa.Table.from_arrays([asks.column("query").take(pa.array(q)), codes.column("rep").take(rows), codes.column("list").take(rows), pa.array(low), pa.array(high)], names)

        schema = StructType([StructField("query", kind), StructField("rep", kind), *StructType.fromDDL("list int, low double, high double")])
        by = ["block", "part"]
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)

    def _measured(self, found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """query, rep, list, distance, rank: the k nearest of the candidates, by exact distances."""
        by_query = Window.partitionBy("query")
        near = found.withColumn("nth", F.row_number().over(by_query.orderBy("high"))).withColumn("bound", F.max(F.when(F.col("nth") == k, F.col("high"))).over(by_query))
        near = near.filter((F.col("low") <= F.col("bound")) | F.col("bound").isNull()).select("query", "rep", "list")
        near = shared.written(near, "ann-near")
        rows = self.lists.select("list", "rep", "embedding")
        small = near.limit(FEW + 1).collect()
        if len(small) <= FEW:  # the files' statistics then tell which pages to read
            rows = rows.filter(F.col("list").isin(sorted({r.list for r in small})) & F.col("rep").isin(sorted({r.rep for r in small}))) if small else rows.limit(0)
        exact = near.join(rows, ["list", "rep"]).join(asked.withColumnRenamed("embedding", "probe"), "query")
        exact = exact.select("query", "rep", "list", vectors.distance(F.col("embedding"), F.col("probe"), self.space).alias("distance"))
        return exact.withColumn("rank", F.row_number().over(by_query.orderBy("distance", "rep"))).filter(F.col("rank") <= k)


def exact(rows: DataFrame, queries: DataFrame, key: str, k: int = vectors.TOP_K, space: str = "cosine") -> DataFrame:
    """The same from a scan of all vectors: an index of one list, which every query probes."""
    folder = shared.scratch_path(rows.sparkSession, "ann-exact")
    build(rows, key, folder, space, lists=1, most=max(k, MOST))
    return Index(rows.sparkSession, folder).search(queries, key, k, probes=1)
