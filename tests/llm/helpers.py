"""Tables that hold every awkward case, and words as the contracts have them."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows, extra=()):
    """rows: (doc_id, text[, source]); extra: names of clashing columns to add."""
    from pyspark.sql import functions as F

    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("clash"))
    return df


LONG = " ".join(f"w{i % 977} of {i}" for i in range(20000))
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "one two three"), (6, LONG), (7, "Émile naïve 😀 Ωmega\u00a0x\r\ny\x0bz"), (8, "a\x00b"), (9, "<|endoftext|> IT'S 12345")]
