"""N-gram Jaccard join: documents whose sets of word shingles are similar, and their groups.

Two documents link when 100 * intersection >= THRESHOLD * union of their sets of WORDS-word
shingles. Equal sets are one class from the start. Of the other sets each puts into an index the
shingles of its prefix: in one order of all shingles, the frequent ones last, so many that linked
sets must have SHARED of them in common (all, if they are fewer). Sets that do are drawn into one
cluster. The sets of a prefix shingle that more than SMALL have are not paired: those are drawn
together whose parities, one bit an element at least, differ in no more bits than linked sets can
in elements. So all links lie inside clusters, and a shingle shared by chance makes none.

The sets of such a shingle, and later those of a cluster, are laid out by size and cut into blocks; a
tile is a pair of blocks whose sizes are compatible, so any number of sets is spread over as many
tasks. Only parities move for a shingle's tiles, texts for a cluster's. There, bitmap
signatures (BITS bits per element, each set by hashed shingles) bound a pair's overlap from above by
(|A| + |B| - popcount(a xor b)) / 2; what passes is settled by intersecting the sorted shingle
arrays of the whole texts. Pairs that the tile's links have joined already are passed over, so a
group of near copies costs about one intersection a member; every pair across groups is decided. A
tile gives the links that join its groups, fewer than it has members.

Which shingles are frequent only affects speed; the list is bounded by FREQUENT. Nothing else
reaches the driver. Of the texts only those in clusters move, once for each block they meet.

No step gathers a key or cluster in one place: counts are made before rows meet, and joins by key are
between written tables, so that a hot one can be split.

Defined cases: texts without words are empty sets, linked with nothing, their own component; a text
of fewer than WORDS words is one shingle; very long texts are whole sets, in bands of their size;
empty tables give empty results; rows of one doc_id are one node; a null doc_id gets its
class's component if its set occurs under an id, else null; extra columns are ignored (join) or
kept (filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, arrow_map, batch_hashes, free_name, mix64
from .components import components

WORDS, THRESHOLD = 4, 85
FREQUENT = 200_000
BLOCK = 256
#: Prefixes are so long that linked sets share so many shingles; tiles of up to SMALL sets are counted by pairs.
SHARED, SMALL = 3, 16
BUCKETS = 1 << 20
#: Of sets that differ in d elements, bitmaps of this many bits an element show some 0.94 d.
BITS = 8
SET_SCHEMA = "doc_id long, n long, set_hash binary, prefix array<long>, parity binary"


def shingles(h: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text, from its words' hashes."""
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(mix64(out))


def sets_of(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of a column."""
    hashes, ends = batch_hashes(texts)
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield shingles(hashes[lo:hi], words)


def need(n: int, m: int, threshold: int) -> int:
    """The least intersection with which sets of these sizes link."""
    return -(-threshold * (n + m) // (100 + threshold))


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bytes per set: a power of two of bits, BITS per element of the largest set at least."""
    width = max(64, 1 << max(0, BITS * max(map(len, sets)) - 1).bit_length())
    out = np.zeros((len(sets), width // 8), np.uint8)
    for row, s in zip(out, sets, strict=True):
        bits = np.zeros(width, bool)
        bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
        row[:] = np.packbits(bits, bitorder="little")
    return out.view(np.uint64)


def parity(s: np.ndarray) -> bytes:
    """Whether an odd number of a set's elements fall on each of a power of two of bits, one an element at least."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def at_width(parities: list[np.ndarray], words: int) -> np.ndarray:
    """A row per parity, folded to so many words of 64 bits; those that are shorter stay empty."""
    out = np.zeros((len(parities), words), np.uint64)
    for row, p in zip(out, parities, strict=True):
        if len(p) >= words:
            row[:] = np.bitwise_xor.reduce(p.reshape(-1, words), 0)
    return out


def _joining(ids: list[int], sizes: np.ndarray, left: list[bool], threshold: int, differing, settled) -> list[tuple[int, int]]:
    """Pairs that join the groups of one tile, between left and other sets, or among all if all are left: those that
    differ in so few bits (differing) that they can link, and pass the check (settled)."""
    own = np.array(left)
    one = own.all()
    group = np.arange(len(ids))
    out = []
    for i in range(len(ids)) if one else np.flatnonzero(own).tolist():
        others = np.arange(i + 1, len(ids)) if one else np.flatnonzero(~own)
        n, m = sizes[i], sizes[others]
        others = others[(100 * np.minimum(n, m) >= threshold * np.maximum(n, m)) & (group[others] != group[i])]
        if not len(others):
            continue
        m = sizes[others]
        least = -(-threshold * (n + m) // (100 + threshold))
        passed = (n + m - differing(i, others)) // 2 >= least
        for j, k in zip(others[passed].tolist(), least[passed].tolist(), strict=True):
            if group[j] != group[i] and settled(i, j, k):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                group[group == group[j]] = group[i]
    return out


def links_in(ids: list[int], sets: list[np.ndarray], left: list[bool], threshold: int) -> list[tuple[int, int]]:
    """Links that join the groups of one tile."""
    signatures = bitmaps(sets)
    differing = lambda i, others: np.bitwise_count(signatures[others] ^ signatures[i]).sum(1, dtype=np.int64)
    settled = lambda i, j, k: len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= k
    return _joining(ids, np.fromiter(map(len, sets), np.int64, len(sets)), left, threshold, differing, settled)


def near_in(ids: list[int], rows: list[tuple[int, bytes]], left: list[bool], threshold: int) -> list[tuple[int, int]]:
    """The same of sets given by size and parity: no link is missing, but not all pairs are links."""
    parities = [np.frombuffer(p, np.uint64) for _, p in rows]
    words = np.fromiter(map(len, parities), np.int64, len(rows))
    at: dict[int, np.ndarray] = {}

    def differing(i: int, others: np.ndarray) -> np.ndarray:
        width = int(min(words[i], words[others].min()))
        if width not in at:
            at[width] = at_width(parities, width)
        return np.bitwise_count(at[width][others] ^ at[width][i]).sum(1, dtype=np.int64)

    return _joining(ids, np.array([n for n, _ in rows], np.int64), left, threshold, differing, lambda i, j, k: True)


def _count_repeated(words: int):
    """Shingles that several texts of a batch share, with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(count[keep])], ["shingle", "n"])

        for batch in batches:
            for s in sets_of(batch.column("text"), words):
                held.append(s)
                size += len(held[-1])
                if size > 1_500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _sets(words: int, threshold: int, shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = shipped.value
        for batch in batches:
            rows = []
            for s in sets_of(batch.column("text"), words):
                n = len(s)
                if not n:
                    rows.append((0, b"", None, None))
                    continue
                prefix = n - -(-threshold * n // 100) + SHARED
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = np.where(frequent[at] == s, rank[at], 0)
                    first = s[np.argsort(late, kind="stable")[:prefix]]
                else:
                    first = s[:prefix]
                rows.append((n, xxhash.xxh3_128_digest(s.tobytes()), first.view(np.int64), parity(s)))
            kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n", "set_hash", "prefix", "parity"])

    return run


def _tiles(given, found_in, threshold: int):
    """Pairs (a, b) that found_in gives of each tile's sets, which given reads from a batch; rows come sorted by tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, left = None, [], [], []

        def done() -> pa.RecordBatch:
            found = found_in(ids, sets, left, threshold) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "nid", "left")), strict=True)
            for (cluster, i, j, nid, side), found in zip(keys, given(batch), strict=True):
                if (cluster, i, j) != now:
                    if len(ids) > 1:
                        yield done()
                    now, ids, sets, left = (cluster, i, j), [], [], []  # a tile has some 4 * BLOCK rows at most
                ids.append(nid)
                sets.append(found)
                left.append(side)
        yield done()

    return run


class Join:
    """The steps over one table of documents (doc_id, text)."""

    def __init__(self, documents: DataFrame, words: int = WORDS, threshold: int = THRESHOLD):
        self.spark, self.words, self.threshold = documents.sparkSession, words, threshold
        self.scratch = Scratch(self.spark, "jaccard")
        self.texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def sets(self) -> DataFrame:
        counts = arrow_map(self.texts.select("text"), _count_repeated(self.words), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        # The most frequent: so many steps of the number of occurrences as leave FREQUENT shingles at most.
        counts = self.scratch.keep(counts.withColumn("step", F.floor(16 * F.log2("n")).cast("int")), "counts")
        least, room = None, FREQUENT
        for step in counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():  # 16 a doubling
            room -= step.n
            if room < 0:
                break
            least = step.step
        rows = counts.filter(F.lit(False) if least is None else F.col("step") >= least).orderBy(F.desc("n"), "shingle").select("shingle").toPandas()
        self.scratch.drop(counts)
        found = rows["shingle"].to_numpy(np.int64).view(np.uint64)
        rank = np.arange(len(found), 0, -1)  # the most frequent comes last
        order = np.argsort(found)
        shipped = self.spark.sparkContext.broadcast((found[order], rank[order]))
        return self.scratch.keep(arrow_map(self.texts, _sets(self.words, self.threshold, shipped), SET_SCHEMA), "sets")

    def texts_of(self, ids: DataFrame) -> DataFrame:
        """nid, text of the ids (nid): texts are filtered by hash buckets of the ids before they move."""
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS))
        wanted = ids.select(bucket("nid").alias("bucket")).distinct()
        # BUCKETS numbers at most are broadcast; they leave the texts wanted, and few others.
        near = self.texts.join(F.broadcast(wanted), bucket("doc_id") == F.col("bucket"), "left_semi")
        return near.select(F.col("doc_id").alias("nid"), "text")

    def clusters(self, firsts: DataFrame) -> DataFrame:
        """nid, n, cluster of every set that may link: SHARED prefix shingles in common, or one of a large tile and near parities.

        Small tiles (up to SMALL sets) give their pairs, and a pair counts its shared shingles; sets that
        share fewer by chance are not drawn together.
        """
        t, scratch = self.threshold, self.scratch
        index = firsts.select("nid", "n", F.explode("prefix").alias("key"))
        members = scratch.keep(index.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "keys")
        tiles = scratch.keep(index.join(members, "key"), "tiles")
        held = tiles.filter(F.col("members") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nid", "n"))).alias("xs"))
        pairs = F.expr(
            f"flatten(transform(xs, (x, i) -> transform(filter(slice(xs, i + 2, size(xs)), y -> 100 * least(x.n, y.n) >= {t} * greatest(x.n, y.n)),"
            " y -> struct(x.nid as a, y.nid as b, least(x.n, y.n) as n))))"
        )
        shared = held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("shared"), F.min("p.n").alias("n"))
        edges = shared.filter(F.col("shared") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * t / 100))).select("a", "b")
        large = scratch.keep(self.in_blocks(tiles.filter(F.col("members") > SMALL).select("nid", "n", F.col("key").alias("cluster"))), "large")
        near = self.tiled(large, firsts.select("nid", "parity"), lambda batch: zip(batch.column("n").to_pylist(), batch.column("parity").to_pylist(), strict=True), near_in)
        found = components(edges.unionByName(near), scratch)
        scratch.drop(members, tiles, large)
        return scratch.keep(found.select(F.col("node").alias("nid"), F.col("component").alias("cluster")).join(firsts.select("nid", "n"), "nid"), "clusters")

    def in_blocks(self, rows: DataFrame) -> DataFrame:
        """rows (nid, n, cluster) with the block of each, by size: one with very many sets is dealt over several. Only counts of sizes are put in order."""
        sizes = rows.groupBy("cluster", "n").agg(F.count(F.lit(1)).alias("count"))
        before = F.sum("count").over(Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
        sizes = self.scratch.keep(sizes.withColumn("before", F.coalesce(before, F.lit(0))), "sizes")
        part = F.pmod(F.xxhash64("nid"), F.ceil(F.col("count") / BLOCK))
        block = (F.shiftleft(F.floor(F.col("before") / BLOCK), 24) + part).alias("block")
        return rows.join(sizes, ["cluster", "n"]).select("nid", "n", "cluster", block)

    def tiled(self, members: DataFrame, held: DataFrame, given, found_in) -> DataFrame:
        """a, b: what found_in gives of the tiles, which are the pairs of blocks of one cluster whose sizes can link; held: what to move of a set (nid)."""
        ranges = members.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
        upper = ranges.select("cluster", F.col("block").alias("j"), F.col("low").alias("low_j"))
        tiles = ranges.select("cluster", F.col("block").alias("i"), "high").join(upper, "cluster").filter((F.col("i") <= F.col("j")) & (100 * F.col("high") >= self.threshold * F.col("low_j"))).select("cluster", "i", "j")
        sides = tiles.select("cluster", "i", "j", F.col("i").alias("block"), F.lit(True).alias("left")).unionByName(tiles.filter("i <> j").select("cluster", "i", "j", F.col("j").alias("block"), F.lit(False).alias("left")))
        rows = members.join(sides, ["cluster", "block"]).drop("block").join(held, "nid")
        return arrow_map(rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "n", "nid"), _tiles(given, found_in, self.threshold), "a long, b long")

    def run(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        words, scratch = self.words, self.scratch
        sets = self.sets()
        classes = scratch.keep(sets.filter("n > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("nid")), "classes")
        firsts = sets.filter("n > 0").join(classes.withColumn("doc_id", F.col("nid")), ["set_hash", "doc_id"]).dropDuplicates(["set_hash", "doc_id"])
        firsts = scratch.keep(firsts.select("nid", "n", "prefix", "parity"), "firsts")
        clusters = self.clusters(firsts)
        scratch.drop(firsts)
        members = scratch.keep(self.in_blocks(clusters), "members")
        links = self.tiled(members, self.texts_of(members), lambda batch: sets_of(batch.column("text"), words), links_in)
        final = components(links, scratch)
        named = classes.join(final.withColumnRenamed("node", "nid"), "nid", "left").select("set_hash", F.coalesce("component", "nid").alias("component_id"))
        named = scratch.keep(named, "named")
        full = sets.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(named, "set_hash", "left").drop("set_hash")
        return full.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def join(documents: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    return Join(documents, words, threshold).run()


def _keep_one_row(documents: DataFrame, words: int, threshold: int) -> DataFrame:
    """keep_one for repeated and null ids: the join is over numbers given to the rows."""
    scratch = Scratch(documents.sparkSession, "groups")
    row = free_name(documents, "row")
    rows = scratch.keep(documents.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = join(rows.select(F.col(row).alias("doc_id"), "text"), words, threshold).select(F.col("doc_id").alias("nth"), "component_id")
    named = groups.join(rows.select(F.col(row).alias("nth"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h")), "nth")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "nth")).alias("x")
    kept = scratch.keep(named.groupBy("component_id").agg(first).select(F.col("x.nth").alias(row)), "kept")
    return rows.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in documents.columns))


def keep_one(documents: DataFrame, words: int = 5, threshold: int = 80) -> DataFrame:
    """One row of each group, the one of the smallest id; documents without words stay.

    Rows of one id are told apart by their texts, then by where they are; null ids come last.
    """
    counts = documents.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    if counts.filter("id is null or n > 1").limit(1).count():
        return _keep_one_row(documents, words, threshold)
    gone = free_name(documents, "gone")
    found = join(documents, words, threshold).filter("component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    found = Scratch(documents.sparkSession, "groups").keep(found, "drop")
    return documents.join(found, F.col("doc_id").cast("long") == F.col(gone), "left_anti")


def oracle_sql(words: int = WORDS, threshold: int = THRESHOLD) -> str:
    """The same in DuckDB, for small tables: shared shingles counted outright between different sets, components by closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) END)) AS s FROM w),
named AS (SELECT doc_id, len(s)::BIGINT AS n, s, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS rep FROM sets),
one AS (SELECT doc_id, n, unnest(s) AS x FROM named WHERE doc_id = rep AND n > 0),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS i FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM both_ WHERE 100 * i >= {threshold} * (n + m - i)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS x, a AS y FROM near UNION SELECT r.x, e.b FROM reach r JOIN near e ON e.a = r.y),
least_ AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, coalesce(c, rep) AS component_id FROM named LEFT JOIN least_ ON x = rep"""
