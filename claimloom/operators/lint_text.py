"""Scans of Markdown text: references in back-ticks, metadata, sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import key_form, strip

# Lines at the top that may hold metadata; endings that make a text a path.
METADATA_LINES = 12
PATH_ENDINGS = [".md", ".yaml", ".yml", ".sql", ".py"]


def quoted(text: Column) -> Column:
    """Distinct texts in back-ticks, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("`([^`]+)`"), F.lit(1))))


def references(documents: DataFrame, key: str = "path") -> DataFrame:
    """key, reference: texts in back-ticks that name paths; web addresses do not count."""
    rows = documents.select(F.col(key), F.explode(quoted(F.col("text"))).alias("r")).select(key, strip(F.col("r")).alias("reference")).distinct()
    ending = F.lit(False)
    for e in PATH_ENDINGS:
        ending = ending | F.col("reference").endswith(e)
    return rows.filter((F.col("reference").contains("/") | ending) & ~F.col("reference").rlike("^https?://"))


def metadata(documents: DataFrame, key: str = "path") -> DataFrame:
    """key, name, value; the last line of a name counts.

    A block between two lines of three hyphens at the top is read if it names anything; else lines
    such as "- name: value" among the first ones are.
    """
    rows = documents.select(key, F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    block = F.expr("transform(split(regexp_extract(text, '^[ \\\\t]*---[ \\\\t]*\\r?\\n([\\\\s\\\\S]*?)(?:\\n[ \\\\t]*---[ \\\\t]*(?:\\r?\\n|$)|$)', 1), '\\n'), x -> x)")
    head = documents.select(key, F.posexplode(block).alias("pos", "line")).filter(F.col("line").contains(":"))
    front = head.select(key, "pos", F.split("line", ":", 2)[0].alias("name"), F.split("line", ":", 2)[1].alias("value"))
    pattern = r"^-\s*([^:]+):\s*(.+)"
    bullets = rows.filter((F.col("pos") < METADATA_LINES) & F.col("line").rlike(pattern)).select(key, "pos", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value"))
    found = front.unionByName(bullets.join(front.select(key).distinct(), key, "left_anti"))
    named = found.select(key, "pos", key_form(F.col("name")).alias("name"), strip(F.col("value")).alias("value"))
    return named.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))


def section(text: Column, heading: str) -> Column:
    """What stands under "## heading", up to the next heading of that level."""
    return strip(F.regexp_extract(text, rf"(?m)^##\s+{re.escape(heading)}\s*$([\s\S]*?)(?=^##\s+|\z)", 1))
