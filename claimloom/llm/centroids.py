"""Centroid clustering in exact integers, with a fast screening in single precision.

A vector's components become integers floor(scale * x). For every batch of vectors one product of
matrices in float32 gives all products with centroids, and with them |c|^2 - 2 x.c, which orders
centroids as distances do. Its rounding error is bounded for any order of summation (screened()),
so each score is an interval that surely holds the true one. Centroids whose interval begins above the
lowest end are out. Where more than one is left, exact integers decide, and of equal distances the
lowest number. So a result does not hang on batches, threads or the machine.

A round is one pass over the vectors (written once, without those left out): each task adds up its
vectors by cluster, and the sums, a few numbers a cluster, are merged in a tree of tasks. Only
centroids and such sums reach the driver. No vector is shuffled.

Integers up to LARGEST run in 64 bits, larger ones as Python's, so that nothing overflows.

Defined cases: vectors that are null, of another length, or hold a null or non-finite component are
left out; with fewer vectors than centroids asked for, each is a centroid at first; repeated vectors
count as often as they are there, and repeated ids too (of starts with one hash those with the smaller
components come first); a null vec_id stays null and hashes as the empty text; sums that a long
cannot hold are null; empty tables, or no vectors, give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator, Sequence
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Components up to this size have differences, squares and their sums over 64 of them in 64 bits.
LARGEST = 1 << 27
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
_LONG = 1 << 63


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite doubles: int64 if none is over LARGEST, else Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if not scaled.size or np.abs(scaled).max() <= LARGEST:
        return scaled.astype(np.int64)
    return np.array([[floor(Fraction(float(x)) * scale) for x in row] for row in values], dtype=object).reshape(values.shape)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows."""
    if x.dtype != c.dtype:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(-1)


def screened(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest, by row: False only where another one is nearer for certain.

    With u = 2^-24 and n components, a sum of products in float32 is off by g sum |x_i c_i| at most, g =
    (n + 2) u / (1 - (n + 2) u), whatever its order, fused or not: two roundings are for taking the
    integers to float32; integers do not underflow. By Cauchy and Schwarz that sum is |x| |c| at most. The
    interval is computed in doubles, which hold these integers, and widened for their own rounding, some
    units of 2^-53, by 2^-40. Integers over LARGEST are not screened.
    """
    if object in (x.dtype, c.dtype):
        return np.ones((len(x), len(c)), bool)
    n = x.shape[1]
    g = (n + 2) * 2.0**-24 / (1 - (n + 2) * 2.0**-24)
    x64, c64 = x.astype(np.float64), c.astype(np.float64)
    products = (x64.astype(np.float32) @ c64.astype(np.float32).T).astype(np.float64)
    norms = (c64 * c64).sum(1)
    lengths = np.sqrt((x64 * x64).sum(1))[:, None] * np.sqrt(norms)[None, :]
    middle = norms[None, :] - 2 * products
    half = 2 * g * lengths * (1 + 2.0**-40) + (norms[None, :] + 2 * lengths) * 2.0**-40
    return middle - half <= (middle + half).min(1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid, the lowest of equals."""
    maybe = screened(x, c)
    cluster = maybe.argmax(1)
    open_ = np.flatnonzero(maybe.sum(1) > 1)
    if len(open_):
        rows, maybe, found = x[open_], maybe[open_], cluster[open_]
        least = distances(rows, c[found])
        for k in range(1, len(c)):
            named = np.flatnonzero(maybe[:, k])
            d = distances(rows[named], c[k])
            closer = (d < least[named]).astype(bool)
            found[named[closer]], least[named[closer]] = k, d[closer]
        cluster[open_] = found
    return cluster


def _vectors(batch: pa.RecordBatch, scale: int) -> np.ndarray:
    column = batch.column("x")
    return integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 1)), scale)


def _table(centroids: list[list[int]]) -> np.ndarray:
    small = all(abs(v) <= LARGEST for c in centroids for v in c)
    return np.array(centroids, dtype=np.int64 if small else object)


Sums = dict[int, tuple[int, list[int], int]]  # by cluster: vectors, sums of components, sum of distances


def _merge(a: Sums, b: Sums) -> Sums:
    for k, (n, s, d) in b.items():
        n0, s0, d0 = a.get(k, (0, [0] * len(s), 0))
        a[k] = n0 + n, [p + q for p, q in zip(s0, s, strict=True)], d0 + d
    return a


def sums(vectors: DataFrame, centroids: list[list[int]], scale: int) -> Sums:
    """One pass: the vectors of each non-empty cluster added up."""
    c = _table(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Sums = {}
        for batch in batches:
            x = _vectors(batch, scale)
            cluster = nearest(x, c)
            far = distances(x, c[cluster])
            for k in np.unique(cluster).tolist():
                of = cluster == k
                # A batch of BATCH_ROWS vectors at most: 64 bits hold its sums.
                found = _merge(found, {k: (int(of.sum()), [int(v) for v in x[of].sum(0)], sum(map(int, far[of])))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["sums"])

    return arrow_map(vectors.select("x"), run, "sums binary").rdd.map(lambda r: pickle.loads(r[0])).treeAggregate({}, _merge, _merge)


def kept(embeddings: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id, x (array of double) of the vectors that count."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = (F.size("x") == size) & F.forall("x", finite)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.coalesce(whole, F.lit(False)))


def trained(vectors: DataFrame, clusters: int, rounds: int, scale: int, seed: str) -> list[list[int]]:
    """The centroids after all rounds."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.orderBy(order, "x").limit(clusters).collect()  # as many rows as there are centroids
    centroids = [[int(v) for v in integers(np.array([r.x]), scale)[0]] for r in first]
    for _ in range(rounds if centroids else 0):
        for k, (n, s, _) in sums(vectors, centroids, scale).items():
            centroids[k] = [v // n for v in s]
    return centroids


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """SCHEMA's row for every vector that counts."""
    vectors = Scratch(embeddings.sparkSession, "centroids").keep(kept(embeddings, size), "vectors")
    centroids = trained(vectors, clusters, rounds, scale, seed)
    found = sums(vectors, centroids, scale) if centroids else {}
    fits = lambda v: int(v) if v < _LONG else None
    inertia = {k: fits(d) for k, (_, _, d) in found.items()}
    total = fits(sum(d for _, _, d in found.values()))
    digests = [digest(c) for c in centroids]
    c = _table(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, scale)
            of = nearest(x, c) if len(x) else np.empty(0, np.int64)
            far = [fits(d) for d in distances(x, c[of]).tolist()] if len(x) else []
            columns = [batch.column("vec_id"), pa.array(of, pa.int32()), pa.array(far, pa.int64()), pa.array([inertia[k] for k in of.tolist()], pa.int64()), pa.array([total] * len(x), pa.int64()), pa.array([digests[k] for k in of.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return arrow_map(vectors, run, SCHEMA)


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle_sql() -> str:
    """The same in DuckDB, round by round, for components whose squares fit 64 bits."""
    steps = []
    for r in range(ROUNDS + 1):
        far = f"SELECT p.row, c.k, sum((p.x - c.x) * (p.x - c.x))::BIGINT AS d FROM parts p JOIN c{r} c ON c.i = p.i GROUP BY p.row, c.k"
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, k, d FROM ({far}) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)")
        if r < ROUNDS:
            mean = f"SELECT a.k, p.i, ((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{r} a JOIN parts p ON p.row = a.row GROUP BY a.k, p.i"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN ({mean}) m ON m.k = c.k AND m.i = c.i)")
    last = ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {SIZE}),
parts AS MATERIALIZED (SELECT row, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v),
c0 AS MATERIALIZED (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS k, x FROM v) WHERE k < {CLUSTERS}),
{', '.join(steps)},
f AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{last} GROUP BY k)
SELECT v.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, f.h AS centroid_sha256
FROM a{last} a JOIN v ON v.row = a.row JOIN f ON f.k = a.k"""
