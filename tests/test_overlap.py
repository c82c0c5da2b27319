"""Overlapping intervals of groups: brute force, hot groups, and ties."""

import random
import time

import pytest
from pyspark.sql import functions as F

from claimloom.operators import overlap


def table(spark, rows):
    rows = spark.createDataFrame(rows, "g string, h string, id string, what string, f long, t long")
    return rows.withColumns({"f": F.timestamp_seconds("f"), "t": F.timestamp_seconds("t")})


def found(spark, rows, **options):
    got = [tuple(r) for r in overlap.pairs(table(spark, rows), ["g", "h"], "id", "what", **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def brute(rows):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[:2] == b[:2] and a[3] != b[3] and a[4] <= b[5] and b[4] <= a[5]:
                out.add((min(a[2], b[2]), max(a[2], b[2])))
    return out


@pytest.mark.parametrize("options", [{}, {"size": 5, "buckets": 4}, {"size": 0, "buckets": 16}])
def test_pairs_equal_brute_force(spark, options):
    rng = random.Random(8)
    rows = []
    for i in range(350):
        f = rng.choice([rng.randrange(100), 50, -(10**10)])
        rows.append((rng.choice("aab"), rng.choice("xy"), f"k{i}", rng.choice(["p", "p", "p", "q", "r", None]), f, rng.choice([f, f + rng.randrange(30), 10**10, f - 3])))
    assert found(spark, rows, **options) == brute(rows)
    assert found(spark, [], **options) == set()


def test_a_hot_group_of_one_item_is_no_burden(spark):
    began = time.time()
    rows = spark.range(100_000).select(F.lit("g").alias("g"), F.lit("h").alias("h"), F.concat(F.lit("k"), "id").alias("id"), F.lit("p").alias("what"), F.lit(0).alias("f"), F.lit(10**9).alias("t"))
    rows = rows.withColumns({"f": F.timestamp_seconds("f"), "t": F.timestamp_seconds("t")})
    assert overlap.pairs(rows, ["g", "h"], "id", "what").count() == 0
    # One claim of another item meets them all; those that it does not meet cost nothing.
    one = table(spark, [("g", "h", "other", "q", 5, 6)])
    assert overlap.pairs(rows.unionByName(one), ["g", "h"], "id", "what").count() == 100_000
    late = rows.withColumns({"f": F.timestamp_seconds(F.lit(100) + F.substring("id", 2, 9).cast("long"))})
    assert overlap.pairs(late.unionByName(one), ["g", "h"], "id", "what").count() == 0
    assert time.time() - began < 60
