"""Pairs of rows of one group whose intervals share a moment and whose items differ.

Groups of one item have no pairs and go first, by a count that is made map-side. What is left is swept by
time: a row is at home in the bucket in which it begins, and active in all buckets that it lasts into; a pair comes
from the bucket of its later beginning, so from one only. Small groups are one bucket; large ones
are cut at quantiles of their beginnings into BUCKETS, so no task holds such a group whole, and a row is
not sent to buckets in which nothing but its own item begins. Inside a bucket items meet before rows do: rows of
one item, however many, are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources import shared

#: Rows of a group that is swept in one bucket; buckets of a larger one.
SIZE, BUCKETS = 1000, 256


def pairs(rows: DataFrame, group: Sequence[str], key: str, item: str, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """first, second: the keys, in order, of rows that overlap; rows: group, key, item (null is an item), f, t (closed, not null).

    A row that ends before it begins overlaps those that span both its ends. Keys are unique.
    """
    group = list(group)
    slim = rows.select(*group, F.col(key).alias("key"), F.col(item).alias("item"), F.unix_micros("f").alias("f"), F.unix_micros("t").alias("t"))
    low, high, some, n = F.min("item"), F.max("item"), F.count("item"), F.count(F.lit(1))
    mixed = (low != high) | ((some > 0) & (some < n))
    live = slim.groupBy(*group).agg(mixed.alias("mixed"), (n > size).alias("hot")).filter("mixed").drop("mixed")
    live = shared.written(slim.join(live, group), "overlap")
    cuts = live.filter("hot").groupBy(*group).agg(F.percentile_approx("f", [k / buckets for k in range(1, buckets)], 40 * buckets).alias("cuts"))
    bucket = lambda x: F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(x))), F.lit(0))
    placed = live.join(cuts, group, "left").select(*group, "key", "item", "f", "t", bucket("f").alias("bucket"), bucket("t").alias("last"))
    placed = shared.written(placed, "overlap-placed")

    homes = placed.drop("last")
    held = homes.groupBy(*group, "bucket").agg(F.when(~mixed, F.struct(low.alias("only"))).alias("single"))
    # What begins in each bucket, by its number: BUCKETS at most.
    there = held.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("single")))).alias("there"), F.max("bucket").alias("most"))
    there = shared.written(there.select(*group, F.transform(F.sequence(F.lit(0), "most"), lambda b: F.try_element_at("there", b)).alias("there")), "overlap-there")

    def other(b):
        begun = F.get("there", b)
        return begun.isNotNull() & (begun["single"].isNull() | ~begun["single"]["only"].eqNullSafe(F.col("item")))

    active = placed.filter("f <= t").join(there, group).select(*group, "key", "item", "f", "t", F.explode(F.filter(F.sequence("bucket", "last"), other)).alias("bucket"))
    active = shared.written(active, "overlap-active")
    by = [*group, "bucket"]
    beginning = homes.groupBy(*by, "item").agg(F.min("f").alias("f0"), F.max("f").alias("f1"))
    lasting = active.groupBy(*by, F.col("item").alias("item2")).agg(F.min("f").alias("g0"), F.max("t").alias("u1"))
    items = beginning.join(lasting, by).filter(~F.col("item").eqNullSafe(F.col("item2")) & (F.col("g0") <= F.col("f1")) & (F.col("u1") >= F.col("f0"))).select(*by, F.struct("item").alias("a"), F.struct(F.col("item2").alias("item")).alias("b"))
    later = homes.select(*by, F.struct("item").alias("a"), F.col("key").alias("key1"), F.col("f").alias("f1"), F.col("t").alias("t1"))
    earlier = active.select(*by, F.struct("item").alias("b"), F.col("key").alias("key2"), F.col("f").alias("f2"), F.col("t").alias("t2"))
    begins_first = (F.col("f2") < F.col("f1")) | ((F.col("f2") == F.col("f1")) & (F.col("key2") < F.col("key1")))
    met = items.join(later, [*by, "a"]).join(earlier, [*by, "b"]).filter(begins_first & (F.col("t2") >= F.col("f1")) & (F.col("t1") >= F.col("f2")))
    return met.select(F.least("key1", "key2").alias("first"), F.greatest("key1", "key2").alias("second"))
