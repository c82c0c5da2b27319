"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are words. Targets follow the weights, stop at a number of epochs, and hand the excess to the
other sources until none is above. The mix is cut into equal-token blocks: they go to the sources
by highest quotients target / (2 k + 1), and each source's blocks beyond whole epochs go to its
shards in the same way, by shard size. A shard lays its documents out in seeded order and gives
the run of blocks that begins at a seeded offset.

Only totals of sources and shards reach the driver. A shard holds SHARD words, or more where the
corpus would have over SHARDS of them. Documents move once, as (id, source, size). To apply a plan,
no text moves: the run that a shard gives is an interval of the seeded order, whose ends are
broadcast (two intervals a shard at most), and a row's place in that order is computed from the row.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
repeated rows are documents of their own; very long texts count whole, and are taken whole or not
(apply); no documents, or none with words, give targets of 0; extra input columns, whatever their
names, are ignored (plan) or kept (apply).
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 16
SHARD, SHARDS = 1_000_000, 20_000
SEED = "mix-1"


def targets(sizes: Sequence[int], weights: Sequence[int], epochs: int = EPOCHS) -> list[float]:
    """Each source's share of all words, none above so many times its size."""
    total, free = sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while free:
        left = total - sum(epochs * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * left > epochs * sizes[i] * weight}
        for i in over or free:
            out[i] = float(epochs * sizes[i]) if over else weights[i] * left / weight
        free = free - over if over else set()
    return out


def sainte_lague(seats: int, shares: Sequence[float]) -> list[int]:
    """Seats by highest quotients share / (2 k + 1); of equal quotients the earlier share's goes first."""
    total = sum(shares)
    if total <= 0 or seats <= 0:
        return [0] * len(shares)
    # A divisor that surely gives too few seats, then one seat at a time: at most a few per share.
    won = [max(0, int(seats * s / total) - 1) for s in shares]
    while sum(won) > seats:
        won = [max(0, w - 1) for w in won]
    queue = [(-s / (2 * w + 1), i) for i, (s, w) in enumerate(zip(shares, won, strict=True)) if s > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(won)):
        _, i = queue[0]
        won[i] += 1
        heapq.heapreplace(queue, (-shares[i] / (2 * won[i] + 1), i))
    # Had a start been too generous, its last seat would be worth less than the best one refused.
    while True:
        worst = max(((-shares[i] / (2 * w - 1), i) for i, w in enumerate(won) if w), default=None)
        best = queue[0]
        if worst is None or worst <= best:
            return won
        won[worst[1]] -= 1
        won[best[1]] += 1
        queue = [(-s / (2 * w + 1), i) for i, (s, w) in enumerate(zip(shares, won, strict=True)) if s > 0]
        heapq.heapify(queue)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(doc_id: Column, source: Column, seed: str) -> Column:
    """A document's place in its source's seeded order."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _number(hexes: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


class Mix:
    """The plan of a mix: totals and quotas on the driver, and every document's part in tables."""

    def __init__(self, documents: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK, shard: int = SHARD, seed: str = SEED):
        spark, self.block, self.seed = documents.sparkSession, block, seed
        self.scratch = Scratch(spark, "mix")
        self.slim = self.scratch.keep(documents.select(*self._keys()), "sizes")
        sources = self.slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
        sources.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r.n for r in sources]
        wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epochs)
        won = sainte_lague(sum(sizes) // block, wanted)
        shard = max(shard, -(-sum(sizes) // SHARDS))
        table = []
        for r, target, blocks in zip(sources, wanted, won, strict=True):
            whole = min(epochs, blocks * block // r.n) if r.n else 0
            rest = (blocks * block - whole * r.n) // block if r.n and whole < epochs else 0
            table.append((r.source, r.n, float(target), int(whole), int(rest), max(1, -(-r.n // shard))))
        #: One row a source.
        self.sources = spark.createDataFrame(table, "of string, source_size long, target double, epochs long, blocks long, shards long")
        # Shards of sources that have blocks to give beyond whole epochs.
        held = self._dealt(self.slim).filter("blocks > 0").groupBy("source", "shard").agg(F.sum("size").alias("n"), F.first("blocks").alias("blocks")).collect()
        by_source: dict = {}
        for r in sorted(held, key=lambda r: r.shard):
            by_source.setdefault(r.source, []).append(r)
        quotas = []
        for source, rows in by_source.items():
            for r, q in zip(rows, sainte_lague(rows[0].blocks, [float(r.n) for r in rows]), strict=True):
                full = -(-r.n // block)
                quotas.append((source, r.shard, int(full), int(min(q, full))))
        #: One row a shard, SHARDS and one a source at most.
        self.quotas = spark.createDataFrame(quotas, "of string, nth long, full long, quota long")

    @staticmethod
    def _keys() -> list[Column]:
        """What places a row: rows that agree in all of these have one text."""
        return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")]

    def _dealt(self, keyed: DataFrame) -> DataFrame:
        """With its source's figures, its place in the seeded order and its shard."""
        out = keyed.join(F.broadcast(self.sources), keyed.source.eqNullSafe(self.sources.of)).drop("of")
        out = out.withColumn("place", _place(F.col("doc_id"), F.col("source"), self.seed))
        return out.withColumn("shard", _number(F.col("place")) % F.col("shards"))

    def _with_quota(self, dealt: DataFrame) -> DataFrame:
        on = dealt.source.eqNullSafe(self.quotas.of) & (dealt.shard == self.quotas.nth)
        return dealt.join(F.broadcast(self.quotas), on, "left").drop("of", "nth")

    def laid(self) -> DataFrame:
        """Every document with rest, the words that its shard's run has of it, and seg, the part of the run it lies in."""
        start = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("place", "size", "hash").rowsBetween(Window.unboundedPreceding, -1))
        laid = self._with_quota(self._dealt(self.slim).withColumn("s", F.coalesce(start, F.lit(0))))
        # The run of blocks [first, first + quota), round the end of the shard.
        named = F.concat_ws("|", F.lit(self.seed), F.lit("shard"), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))
        first = _number(F.md5(named.cast("binary"))) % F.greatest("full", F.lit(1))
        laid = laid.withColumn("lo", first * self.block).withColumn("hi", (first + F.col("quota")) * self.block).withColumn("e", F.col("s") + F.col("size"))
        around = F.col("hi") - F.col("full") * self.block
        common = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("e"), hi) - F.greatest(F.col("s"), lo))
        main = F.coalesce(common(F.col("lo"), F.col("hi")), F.lit(0))
        rest = main + F.coalesce(common(F.lit(0), around), F.lit(0))
        return laid.withColumns({"seg": F.when(main > 0, 1).otherwise(2), "rest": rest.cast("long")})

    def plan(self) -> DataFrame:
        taken = (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken")
        return self.laid().select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", taken)

    def applied(self, documents: DataFrame) -> DataFrame:
        """The documents, each as often as it is taken."""
        key = F.struct("place", "size", "hash")
        more = (F.col("rest") > 0) & (2 * F.col("rest") >= F.col("size"))
        laid = self.laid().select("source", "shard", "seg", key.alias("key"), more.alias("more"))
        runs = laid.filter("more").groupBy("source", "shard", "seg").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        runs = self.scratch.keep(runs.groupBy(F.col("source").alias("of"), F.col("shard").alias("nth")).agg(F.collect_list(F.struct("low", "high")).alias("runs")), "runs")
        on = lambda df: df.source.eqNullSafe(runs.of) & (df.shard == runs.nth)
        # Equal rows at a run's end of which it takes some: rare, and told apart by number.
        ends = laid.join(F.broadcast(runs), on(laid)).filter(F.exists("runs", lambda r: (r.low == F.col("key")) | (r.high == F.col("key"))))
        ends = ends.groupBy("source", "key").agg(F.count_if("more").alias("some"), F.count(F.lit(1)).alias("all")).filter("some < all")
        ends = self.scratch.keep(ends.withColumnsRenamed({"source": "from", "key": "edge"}), "ends")
        rows = self._dealt(documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), *self._keys())).withColumn("key", key)
        rows = rows.join(F.broadcast(runs), on(rows), "left")
        inside = F.coalesce(F.exists("runs", lambda r: F.col("key").between(r.low, r.high)), F.lit(False)) & (F.col("size") > 0)
        rows = rows.select("row", "source", "key", "epochs", inside.alias("inside"))
        times = F.col("epochs") + F.col("inside").cast("int")
        if ends.limit(1).count():
            uneven = rows.join(F.broadcast(ends), rows.source.eqNullSafe(ends["from"]) & (rows.key == ends.edge))  # two a shard at most
            nth = F.row_number().over(Window.partitionBy("source", "key").orderBy(F.lit(0)))
            uneven = uneven.select("row", (F.col("epochs") + (nth <= F.col("some")).cast("int")).alias("times"))
            even = rows.join(F.broadcast(ends), rows.source.eqNullSafe(ends["from"]) & (rows.key == ends.edge), "left_anti")
            taken = even.select("row", times.alias("times")).unionByName(uneven)
        else:
            taken = rows.select("row", times.alias("times"))
        return taken.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


def plan_mix(documents: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, rest, taken for every row.

    taken = epochs * size + rest; rest is what the run of blocks holds of the document.
    """
    return Mix(documents, **options).plan()


def mix_digest(documents: DataFrame, **options) -> DataFrame:
    return plan_mix(documents, **options).select("doc_id", "size", "source_size", "target", "taken")


def apply_mix(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, whole, with all their columns: each as often as it is taken.

    A document in which the run of blocks begins or ends is taken once more if half of its words or
    more lie in the run.
    """
    return Mix(documents, **options).applied(documents)


def oracle_sql() -> str:
    """The same in DuckDB: targets by running sums in order of saturation, seats by ranking all quotients."""
    number = "('0x' || substr({}, 1, 8))::BIGINT"
    weight = "CASE k % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    common = "greatest(0, least(s + size, {b}) - greatest(s, {a}))"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(concat_ws('|', '{SEED}', coalesce(source, ''), coalesce(doc_id::VARCHAR, ''))) AS place FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
s1 AS (SELECT *, {weight} AS w, (sum(n) OVER ())::BIGINT AS t FROM s0),
s2 AS (SELECT *, coalesce(sum({EPOCHS} * n) OVER a, 0) AS before, (sum(w) OVER ()) - coalesce(sum(w) OVER a, 0) AS wleft FROM s1
  WINDOW a AS (ORDER BY n::DOUBLE / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, w * (t - before) > {EPOCHS} * n * wleft AS full_ FROM s2),
s4 AS (SELECT *, t - coalesce((sum({EPOCHS} * n) FILTER (full_) OVER ()), 0) AS remains, sum(w) FILTER (NOT full_) OVER () AS wsum FROM s3),
s5 AS (SELECT source, k, n, t, CASE WHEN full_ THEN ({EPOCHS} * n)::DOUBLE ELSE (w * remains)::DOUBLE / wsum::DOUBLE END AS target FROM s4),
q AS (SELECT k, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k) AS nth, t FROM (SELECT *, unnest(range(0, {EPOCHS} * n // {BLOCK} + 3)) AS i FROM s5) WHERE target > 0),
s6 AS (SELECT s5.*, coalesce(x.won, 0) AS won FROM s5 LEFT JOIN (SELECT k, count(*) AS won FROM q WHERE nth <= t // {BLOCK} GROUP BY k) x ON x.k = s5.k),
s7 AS (SELECT *, CASE WHEN n > 0 THEN least({EPOCHS}, won * {BLOCK} // n) ELSE 0 END AS epochs, greatest(1, (n + size - 1) // size) AS shards FROM (SELECT *, greatest({SHARD}, (t + {SHARDS} - 1) // {SHARDS})::BIGINT AS size FROM s6)),
s8 AS (SELECT *, CASE WHEN n > 0 AND epochs < {EPOCHS} THEN (won * {BLOCK} - epochs * n) // {BLOCK} ELSE 0 END AS blocks FROM s7),
l AS (SELECT d.*, s8.n, s8.target, s8.epochs, s8.blocks, {number.format('place')} % s8.shards AS shard FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source),
h0 AS (SELECT source, shard, sum(size) AS n, any_value(blocks) AS blocks FROM l WHERE blocks > 0 GROUP BY ALL),
h1 AS (SELECT source, shard, n, row_number() OVER (PARTITION BY source ORDER BY n::DOUBLE / (2 * i + 1) DESC, shard) <= blocks AS won FROM (SELECT *, unnest(range(0, blocks)) AS i FROM h0)),
h2 AS (SELECT source, shard, (n + {BLOCK} - 1) // {BLOCK} AS full_, least(count(*) FILTER (won), (n + {BLOCK} - 1) // {BLOCK}) AS quota FROM h1 GROUP BY source, shard, n),
p AS (SELECT l.*, coalesce(sum(size) OVER (PARTITION BY l.source, l.shard ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, full_, quota,
  {number.format(f"md5(concat_ws('|', '{SEED}', 'shard', coalesce(l.source, ''), l.shard::VARCHAR))")} % greatest(coalesce(full_, 1), 1) AS first
  FROM l LEFT JOIN h2 ON l.source IS NOT DISTINCT FROM h2.source AND l.shard = h2.shard)
SELECT doc_id, size, n AS source_size, target,
  (epochs * size + coalesce({common.format(a=f'first * {BLOCK}', b=f'(first + quota) * {BLOCK}')} + {common.format(a='0', b=f'(first + quota - full_) * {BLOCK}')}, 0))::BIGINT AS taken FROM p"""
