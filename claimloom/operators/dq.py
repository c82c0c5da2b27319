"""Row checks that many rules share: keys, required fields, references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.text import missing


def issue(rows: DataFrame, level: str, code: str, key: Column, detail: Column | None = None) -> DataFrame:
    """level, code, record, detail: one row a finding."""
    return rows.select(F.lit(level).alias("level"), F.lit(code).alias("code"), F.coalesce(key.cast("string"), F.lit("")).alias("record"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def first_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key, without rows that have none."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.filter(~missing(F.col(key))).withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def last_by_key(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")


def duplicate_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, extra: rows beyond the first of each key. Counted map-side, so a hot key is no burden."""
    counts = rows.filter(~missing(F.col(key))).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter("n > 1").select(F.col(key), (F.col("n") - 1).alias("extra"))


def missing_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.filter(missing(F.col(key)))


def missing_fields(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, field: one row for each required field that is null or empty."""
    marks = F.array_compact(F.array(*(F.when(missing(F.col(f)), F.lit(f)) for f in fields)))
    return rows.filter(F.greatest(*(missing(F.col(f)).cast("int") for f in fields)) == 1).select(F.col(key), F.explode(marks).alias("field"))


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference is given but names no parent."""
    named = rows.filter(~missing(F.col(key)))
    return named.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """key, n: rows of each key, and of none (null), counted map-side."""
    return rows.groupBy(F.when(~missing(F.col(key)), F.col(key)).alias("key")).agg(F.count(F.lit(1)).alias("n"))
