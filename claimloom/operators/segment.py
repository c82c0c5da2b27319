"""Cutting documents into stable, offset-addressed segments, and linking segments to claims.

Offsets are code points from 0, ends exclusive. All is done in a document's own row, without a
shuffle: headings, sections and windows by DataFrame functions; lines, paragraphs (whose offsets are
running sums) and packing paragraphs greedily up to a size as Arrow maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import slug, text_hash

VERSION = "segmenter-v1"
MAX_CHARS, OVERLAP = 1200, 150
# File endings of text documents; underlines of titles by level.
TEXT_SUFFIXES = [".md", ".markdown", ".txt", ".rst"]
UNDERLINES = "=-~^\"'`:+*#"


def text_documents(documents: DataFrame) -> DataFrame:
    """Documents whose path ends as text files do."""
    return documents.filter(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(TEXT_SUFFIXES))


_MARKS = "array<struct<start_char:bigint,level:bigint,title:string>>"
_HEADING = r"^(#{1,6})\s+(.*\S)\s*$"


def _cut(text: str = "text") -> Column:
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)


def _within(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items of rows that end at ends[1:]: each one's row, and its number in it."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    return row, np.arange(len(row)) - ends[row]


def _starts(sizes: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The sum of the sizes before each item in its row."""
    before = np.append(0, np.cumsum(sizes))
    return before[:-1] - before[ends[row]]


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    ends = column.offsets.to_numpy()
    return column.flatten(), ends - ends[0]


def lines(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, line (from 1), start_char, line_text; line ends are \\n, \\r\\n counts as one. A null text has none; rows of one key are cut apart."""
    slim = documents.filter(F.col("text").isNotNull()).select(key, F.regexp_replace("text", "\r\n?", "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _lists(pc.split_pattern(batch.column(1), "\n"))
            row, nth = _within(ends)
            sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            start = _starts(sizes + 1, ends, row)
            # What follows the last line end is a line only if there is something.
            keep = np.flatnonzero((np.arange(len(row)) + 1 < ends[row + 1]) | (sizes > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(nth[keep] + 1), pa.array(start[keep]), flat.take(pa.array(keep))], [key, "line", "start_char", "line_text"])

    return slim.mapInArrow(run, slim.select(key).schema.add("line", "long").add("start_char", "long").add("line_text", "string"))


def _fold(items: Column, size, fits, level, title) -> Column:
    """The marks among a text's lines, in one walk over them that adds up their sizes."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_MARKS).alias("marks"))

    def step(state: Column, x: Column) -> Column:
        mark = F.struct(state.at.alias("start_char"), level(x).cast("long").alias("level"), title(x).alias("title"))
        marks = F.when(fits(x), F.concat(state.marks, F.array(mark))).otherwise(state.marks)
        return F.struct((state.at + size(x) + 1).cast("long").alias("at"), marks.cast(_MARKS).alias("marks"))

    return F.aggregate(items, zero, step, lambda state: state.marks)


def heading_marks() -> Column:
    """Array of (start_char, level, title) of a text's lines such as "## Title"."""
    return _fold(_cut(), F.length, lambda x: x.rlike(_HEADING), lambda x: F.length(F.regexp_extract(x, _HEADING, 1)), lambda x: F.regexp_extract(x, _HEADING, 2))


def underlined_marks() -> Column:
    """Array of (start_char, level, title) of a text's lines underlined by one repeated character, long enough."""
    pairs = F.arrays_zip(_cut().alias("title"), F.slice(_cut(), 2, F.size(_cut())).alias("under"))
    first = lambda x: F.substring(x.under, 1, 1)
    level = lambda x: F.instr(F.lit(UNDERLINES), first(x))

    def fits(x: Column) -> Column:
        same = x.under == F.repeat(first(x), F.length(x.under))
        return (F.trim(x.title) != "") & (x.under != "") & same & (level(x) > 0) & (F.length(x.under) >= F.length(F.trim(x.title)))

    return _fold(pairs, lambda x: F.length(x.title), fits, level, lambda x: F.trim(x.title))


def headings(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, start_char, level, title of lines such as "## Title"."""
    return documents.select(key, F.inline(heading_marks()))


def underlined_headings(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, start_char, level, title of lines underlined by one repeated character, long enough."""
    return documents.select(key, F.inline(underlined_marks()))


def with_sections(documents: DataFrame, marks: Column) -> DataFrame:
    """The rows with sections: array of (start_char, end_char, heading_path)."""
    marked = documents.withColumn("hs", F.coalesce(marks, F.array().cast(_MARKS)))
    # hs and paths stay columns of their own: they are named more than once below, so the optimizer does not repeat their walks.
    still = "concat(filter(state.open, o -> o.level < h.level), array(h))"
    paths = F.expr(
        f"aggregate(hs, named_struct('open', cast(array() as {_MARKS}), 'paths', array(cast(array() as array<string>))),"
        f" (state, h) -> named_struct('open', {still}, 'paths', concat(state.paths, array(transform({still}, o -> o.title)))), state -> state.paths)"
    )
    cut = F.expr(
        "transform(paths, (p, i) -> named_struct('start_char', if(i = 0, 0L, get(hs, i - 1).start_char),"
        " 'end_char', if(i < size(hs), get(hs, i).start_char, cast(length(text) as bigint)), 'heading_path', p))"
    )
    solid = "s -> s.end_char > s.start_char and (s.start_char > 0 or size(hs) = 0 or size(s.heading_path) > 0 or substring(text, 1, cast(s.end_char as int)) rlike '\\\\S')"
    return marked.withColumn("paths", paths).withColumn("sections", cut).withColumn("sections", F.expr(f"filter(sections, {solid})")).drop("hs", "paths")


def sections(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, start_char, end_char, heading_path: from each heading to the next, and what is before the first.

    A heading's path holds the nearest earlier heading of each lower level: headings still open.
    """
    return with_sections(documents.select(key, "text"), heading_marks()).select(key, F.inline("sections"))


def paragraphs(documents: DataFrame, key: str = "document_id") -> DataFrame:
    """key, start_char, end_char of the parts between blank lines that hold anything."""
    gap = r"\n\s*\n"
    sized = documents.filter(F.col("text").isNotNull()).select(
        key,
        F.transform(F.split("text", gap, -1), lambda x: F.when(x.rlike(r"\S"), F.length(x)).otherwise(-1 - F.length(x))).alias("parts"),
        F.transform(F.concat(F.regexp_extract_all("text", F.lit(gap), F.lit(0)), F.array(F.lit(""))), F.length).alias("gaps"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (parts, ends), (gaps, _) = _lists(batch.column(1)), _lists(batch.column(2))
            parts, gaps = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (parts, gaps))
            row, _ = _within(ends)
            sizes = np.where(parts < 0, -1 - parts, parts)
            start = _starts(sizes + gaps, ends, row)
            keep = np.flatnonzero(parts >= 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[keep])), pa.array(start[keep]), pa.array((start + sizes)[keep])], [key, "start_char", "end_char"])

    return sized.mapInArrow(run, sized.select(key).schema.add("start_char", "long").add("end_char", "long"))


def windows(documents: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, key: str = "document_id") -> DataFrame:
    """The input's rows with ordinal, start_char, end_char for every window over its text.

    Windows begin a stride apart and the last one ends with the text, so their number is known.
    """
    stride = max(1, max_chars - overlap)
    size = F.length("text")
    n = F.when(size > max_chars, 1 + F.ceil((size - max_chars) / stride)).otherwise(F.when(size > 0, 1).otherwise(0))
    rows = documents.filter(F.col("text").isNotNull() & (size > 0)).withColumn("ordinal", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))))
    start = (F.col("ordinal") - 1) * stride
    return rows.withColumn("start_char", start).withColumn("end_char", F.least(start + max_chars, F.length("text").cast("long")))


def _slide(start: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    while True:
        stop = min(end, start + size)
        yield start, stop
        if stop >= end:
            return
        start = max(start + 1, stop - overlap)


_BLANK_LINE = re.compile(r"\n\s*\n")


def pack_section(text: str, start: int, end: int, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of up to max_chars: paragraphs joined while they fit, longer ones cut into windows."""
    edges, at = [], start
    for gap in _BLANK_LINE.finditer(text, start, end):
        edges.append((at, gap.start()))
        at = gap.end()
    edges.append((at, end))
    out: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for a, b in edges:
        if not text[a:b].strip():
            continue
        if held and b - held[0] <= max_chars:
            held = held[0], b
            continue
        if held:
            out.append(held)
            held = None
        if b - a <= max_chars:
            held = a, b
        else:
            out.extend(s for s in _slide(a, b, max_chars, overlap) if text[s[0] : s[1]].strip())
    return [*out, held] if held else out


def build(documents: DataFrame, links: DataFrame | None = None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Segment rows of documents (document_id, document_type, status, text, optional path): sections, packed.

    links (segment_id, claim_ids, entity_ids) are added if given; empty lists are null.
    """
    marks = heading_marks()
    if "path" in documents.columns:
        rst, plain = F.lower("path").endswith(".rst"), F.lower("path").endswith(".txt")
        marks = F.when(rst, underlined_marks()).when(~plain, marks)
    placed = with_sections(documents.select("document_id", "document_type", "status", "text", *(c for c in ["path"] if c in documents.columns)), marks)
    placed = placed.filter(F.size("sections") > 0).select("document_id", "document_type", "status", "text", "sections")
    spans = "document_id string, document_type string, status string, ordinal long, start_char long, end_char long, text string, heading_path array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                n = 0
                for s in r["sections"]:
                    for a, b in pack_section(r["text"], s["start_char"], s["end_char"], max_chars, overlap):
                        n += 1
                        rows.append((r["document_id"], r["document_type"], r["status"], n, a, b, r["text"][a:b], s["heading_path"]))
            names = [x.split()[0] for x in spans.split(", ")]
            kinds = [*[pa.string()] * 3, *[pa.int64()] * 3, pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names)

    out = placed.mapInArrow(run, spans).withColumn("segment_id", F.format_string("seg:%s:%03d", "document_id", "ordinal"))
    out = out.withColumns({"text_hash": text_hash(F.col("text")), "segmenter_version": F.lit(VERSION)})
    tags = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array("document_type"), F.transform("heading_path", slug)))))
    out = out.withColumn("tags", tags)
    if links is not None:
        out = out.join(links, "segment_id", "left")
        out = out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("claim_ids", "entity_ids")})
    return out.withColumn("heading_path", F.when(F.size("heading_path") > 0, F.col("heading_path")))


def coverage(documents: DataFrame) -> DataFrame:
    """kind, n: documents that are segmented, whose file is of no supported kind, and that have no text."""
    supported = F.lower("path").rlike("[.](" + "|".join(s[1:] for s in TEXT_SUFFIXES) + ")$")
    kind = F.when(F.col("text").isNull(), "missing").when(~F.coalesce(supported, F.lit(False)), "unsupported").otherwise("segmented")
    return documents.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def links(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """segment_id, claim_ids, entity_ids: what claims say of their segments, and evidence of its claims."""
    ends = claims.select("claim_id", F.array("subject_id", "object_id").alias("ends"))
    own = claims.select(F.col("source_segment_id").alias("segment_id"), "claim_id", F.array("subject_id", "object_id").alias("ends"))
    shown = evidence.select(F.col("source_segment_id").alias("segment_id"), "claim_id").distinct().join(ends, "claim_id", "left").select("segment_id", "claim_id", "ends")
    both = own.unionByName(shown).filter(F.coalesce(F.col("segment_id") != "", F.lit(False)) & F.col("claim_id").isNotNull())
    flat = both.select("segment_id", F.explode(F.concat(F.array(F.struct(F.lit("c").alias("k"), F.col("claim_id").alias("v"))), F.transform(F.coalesce("ends", F.array().cast("array<string>")), lambda e: F.struct(F.lit("e").alias("k"), e.alias("v"))))).alias("x")).distinct()
    pick = lambda k: F.array_sort(F.collect_set(F.when((F.col("x.k") == k) & (F.col("x.v") != ""), F.col("x.v"))))
    return flat.groupBy("segment_id").agg(pick("c").alias("claim_ids"), pick("e").alias("entity_ids"))


def star_segments(docs: DataFrame, max_chars: int, overlap: int, spoiled: int) -> DataFrame:
    """Segments of the star's documents: windows, with a wrong hash for one ordinal in so many documents."""
    cut = windows(docs.filter("text is not null"), max_chars, overlap)
    body = F.expr("substring(text, cast(start_char + 1 as int), cast(end_char - start_char as int))")
    number = F.regexp_extract("document_id", r"(\d+)$", 1).cast("long") + F.col("ordinal")
    rows = cut.select(
        F.concat(F.lit("seg:"), "document_id", F.lit(":"), F.format_string("%03d", "ordinal")).alias("segment_id"), "document_id",
        F.when(number % 89 == 1, "letter").when(number % 83 == 1, "").otherwise(F.col("document_type")).alias("document_type"), body.alias("text"), "start_char",
        F.when(number % 79 == 1, F.col("end_char") + 5000).when(number % 73 == 1, F.col("start_char") - 1).when(number % 71 == 1, F.col("end_char") - 1).otherwise(F.col("end_char")).alias("end_char"),
        "ordinal", "status", F.when(number % spoiled == 0, "spoiled").otherwise(text_hash(body)).alias("text_hash"), F.lit(VERSION).alias("segmenter_version"),
        F.when(F.col("ordinal") % 2 == 1, F.array(F.concat(F.lit("customer."), F.col("ordinal").cast("string")))).alias("entity_ids"),
    )
    return rows


def star_segments_sql(max_chars: int, overlap: int, spoiled: int) -> str:
    stride = max_chars - overlap
    return f"""SELECT 'seg:' || document_id || ':' || CASE WHEN o < 1000 THEN lpad(o::VARCHAR, 3, '0') ELSE o::VARCHAR END AS segment_id, document_id,
  CASE WHEN k % 89 = 1 THEN 'letter' WHEN k % 83 = 1 THEN '' ELSE document_type END AS document_type, body AS text, s::BIGINT AS start_char,
  (CASE WHEN k % 79 = 1 THEN e + 5000 WHEN k % 73 = 1 THEN s - 1 WHEN k % 71 = 1 THEN e - 1 ELSE e END)::BIGINT AS end_char,
  o::BIGINT AS ordinal, status, CASE WHEN k % {spoiled} = 0 THEN 'spoiled' ELSE sha256(body) END AS text_hash, '{VERSION}' AS segmenter_version,
  CASE WHEN o % 2 = 1 THEN ['customer.' || o::VARCHAR] END AS entity_ids
FROM (SELECT *, substr(text, (s + 1)::INT, (e - s)::INT) AS body FROM (SELECT *, (o - 1) * {stride} AS s, least((o - 1) * {stride} + {max_chars}, length(text)) AS e,
  regexp_extract(document_id, '(\\d+)$', 1)::BIGINT + o AS k
  FROM (SELECT *, unnest(range(1, 2 + CASE WHEN length(text) > {max_chars} THEN ceil((length(text) - {max_chars})::DOUBLE / {stride})::BIGINT ELSE 0 END)) AS o FROM docs WHERE length(text) > 0)))"""
