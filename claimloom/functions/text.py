"""Column expressions: hashing, names, time stamps, tokens. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the plain trim functions know the blank only.
_SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{_SPACE}+|{_SPACE}+$", "")


def missing(x: Column) -> Column:
    """Null or the empty string; 0, false and blanks count as values."""
    return x.isNull() | (x.cast("string") == "")


def present(x: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(strip(x) != "", F.lit(False))


def text_hash(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def slug(x: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens; "untitled" if none."""
    hyphened = F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(hyphened, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def match_form(x: Column) -> Column:
    return F.lower(strip(F.coalesce(x, F.lit(""))))


def key_form(x: Column) -> Column:
    """Stripped, lower-case, blanks and hyphens as underscores."""
    return F.translate(F.lower(strip(x)), " -", "__")


def truth_form(x: Column) -> Column:
    """yes and no for truth values, else the text in lower case."""
    low = F.lower(strip(x))
    return F.when(low.isin("true", "yes"), "yes").when(low.isin("false", "no"), "no").otherwise(low)


def moment(x: Column) -> Column:
    """An ISO-8601 text as timestamp; null if it is none. Without a zone it is UTC."""
    return F.try_to_timestamp(x)


def windows_overlap(from_a: Column, to_a: Column, from_b: Column, to_b: Column) -> Column:
    """Whether two closed intervals share a moment; null ends are open."""
    low, high = F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59").cast("timestamp")
    return (F.coalesce(from_a, low) <= F.coalesce(to_b, high)) & (F.coalesce(from_b, low) <= F.coalesce(to_a, high))


def tokens(x: Column) -> Column:
    """ASCII words of the text in lower case; one placeholder if there are none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("__empty__")))


def encode_value(x: Column) -> Column:
    """Lists and maps as JSON text, scalars as they are."""
    return F.to_json(x)


def looks_like_json(x: Column) -> Column:
    return F.substring(strip(x), 1, 1).isin("[", "{")


def decode_list(x: Column) -> Column:
    """The list that a text encodes; a text that encodes none is its own only element."""
    return F.coalesce(F.when(looks_like_json(x), F.from_json(x, "array<string>")), F.array(x))


def whole(x: Column) -> Column:
    """As integer, null if it is none."""
    return x.try_cast("bigint")
