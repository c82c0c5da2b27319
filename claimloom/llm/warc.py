"""WARC volumes and a Merkle fixity audit of replicas, in DataFrame operations.

Pages become records; records in order of their ids are laid into volumes, each at the byte offset
where the one before it ends. An archive is a table (volume, offset, page_id, record).

Each record is hashed. The records that begin in one range of RANGE bytes of a volume are hashed, in
order of their offsets, into a node; 16 ranges into a wider one; those into the volume's; volumes
into nodes by prefixes of their names' hashes, up to the root. Two replicas are compared from their
roots: only the children of nodes that differ are looked at, so a sound replica is settled at the
root, and corruption is located by volume and offset in as many steps as the tree has levels.

Trees are tables of digests, spread by node. A volume holds PER_VOLUME ids; ids with very many
records have their range dealt over several volumes by digest, so that no volume is a hot group.
Records are laid out once, and read once per replica.

Defined cases: null ids have volumes of their own; a null url or html is the empty text; repeated
records stand one after another at offsets of their own; very long records are one leaf; empty
archives have no root and are equal; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

PER_VOLUME, CROWD = 1024, 4
#: Crowded ranges, of a few bytes each, that are broadcast.
BROADCAST = 100_000
#: Bits of an offset within a range, and within a wider one.
RANGE, WIDER = 16, 20
#: Fixed by the WARC format.
VERSION, END = "WARC/1.1", "\r\n"


def record_of(page_id: Column, url: Column, html: Column) -> Column:
    """The page as one resource record: header lines, an empty line, the body, two line ends."""
    body = F.coalesce(html, F.lit(""))
    ident = F.md5(F.coalesce(page_id.cast("string"), F.lit("")).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(ident, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(
        F.lit(f"{VERSION}{END}WARC-Type: resource{END}WARC-Record-ID: <urn:uuid:"),
        uuid,
        F.lit(f">{END}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{END}WARC-Date: 2000-01-01T00:00:00Z{END}Content-Type: text/html{END}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END * 2),
        body,
        F.lit(END * 2),
    )


def to_records(pages: DataFrame) -> DataFrame:
    """page_id, record."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.select("page_id", record_of(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the body of one record; ValueError if it is damaged."""
    head, split, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if size < 0 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the body has not the length stated")
    return fields, rest[:size]


def read_records(data: bytes) -> list[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, body) of each record of an uncompressed or gzip-per-record archive."""
    import zlib

    out, at = [], 0
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            record = member.decompress(data[at:])
            if not member.eof:
                raise ValueError("truncated gzip member")
            used = len(data) - at - len(member.unused_data)
        else:
            head = data.index(b"\r\n\r\n", at) + 4
            size = int(next(x.split(b":")[1] for x in data[at:head].split(b"\r\n") if x.lower().startswith(b"content-length:")))
            record, used = data[at : head + size + 4], head + size + 4 - at
        out.append((at, *parse_record(record)))
        at += used
    return out


def lay_out(records: DataFrame) -> DataFrame:
    """volume, offset, page_id, record: the records in order of id (and digest), one after another.

    A range of ids with more than CROWD records an id is dealt over several volumes.
    """
    size = F.octet_length("record").cast("long")
    span = F.floor(F.col("page_id") / PER_VOLUME)
    crowded = records.groupBy(span.alias("of")).agg(F.ceil(F.count(F.lit(1)) / (CROWD * PER_VOLUME)).alias("parts")).filter("parts > 1")
    crowded = Scratch(records.sparkSession, "crowded").keep(crowded, "ranges")
    hashed = records.select("page_id", "record", size.alias("size"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"), span.alias("span"))
    if n := crowded.count():  # else no record moves for it
        dealt = hashed.join(F.broadcast(crowded) if n <= BROADCAST else crowded, hashed.span.eqNullSafe(crowded.of), "left")
    else:
        dealt = hashed.withColumn("parts", F.lit(None).cast("long"))
    part = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.coalesce("parts", F.lit(1))
    dealt = dealt.withColumn("volume", F.concat_ws("-", F.coalesce(F.col("span").cast("string"), F.lit("none")), part.cast("string")))
    before = F.sum("size").over(Window.partitionBy("volume").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.select("volume", F.coalesce(before, F.lit(0)).cast("long").alias("offset"), "page_id", "record")


def leaves(archive: DataFrame) -> DataFrame:
    """volume, offset, page_id, n_bytes, digest and the number of equal ones there."""
    hashed = archive.select("volume", "offset", "page_id", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    return hashed.groupBy("volume", "offset", "page_id", "n_bytes", "digest").agg(F.count(F.lit(1)).alias("copies"))


#: From a record's range up to the root.
_LEVELS = ("narrow", "wide", "volume", "six", "four", "two", "root")


def _path(volume: Column, offset: Column) -> dict[str, Column]:
    name = F.md5(volume.cast("binary"))
    at = lambda bits: F.concat_ws("|", volume, F.shiftright(offset, bits).cast("string"))
    return {"narrow": at(RANGE), "wide": at(WIDER), "volume": volume, "six": F.substring(name, 1, 6), "four": F.substring(name, 1, 4), "two": F.substring(name, 1, 2), "root": F.lit("")}


def tree(hashed: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """For each of _LEVELS a table of that level's key, its ancestors' and the node's digest."""
    child = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "n_bytes", "digest", "copies")
    below, out = hashed.withColumns(_path(F.col("volume"), F.col("offset"))), []
    for k, level in enumerate(_LEVELS):
        joined = F.array_join(F.array_sort(F.collect_list(child)), "|")
        below = below.groupBy(*_LEVELS[k:]).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
        below = scratch.keep(below, level) if level in ("narrow", "volume") else below
        out.append(below)
        child = F.concat_ws(":", level, "digest")
    return out


def differing(mine: list[DataFrame], theirs: list[DataFrame], scratch: Scratch) -> DataFrame:
    """The ranges (narrow) whose digests differ: from the root, the children of differing nodes only."""
    suspect = None
    for k in range(len(_LEVELS) - 1, -1, -1):
        level, a, b = _LEVELS[k], mine[k], theirs[k]
        if suspect is not None:
            a, b = (x.join(suspect, _LEVELS[k + 1], "left_semi") for x in (a, b))
        both = a.select(level, F.col("digest").alias("mine")).join(b.select(level, F.col("digest").alias("theirs")), level, "full")
        suspect = scratch.keep(both.filter(~F.col("mine").eqNullSafe(F.col("theirs"))).select(level), level)
    return suspect


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, volume, offset, n_bytes, sha256, copies, status of every record of either archive.

    status: intact; changed (other contents at this offset); moved (its contents are in the volume,
    elsewhere); missing; copies (there, but not as often); extra (only in the replica: the row is its).
    """
    scratch = Scratch(archive.sparkSession, "warc")
    mine, theirs = scratch.keep(leaves(archive), "mine"), scratch.keep(leaves(replica), "theirs")
    ranges = differing(tree(mine, scratch), tree(theirs, scratch), scratch)
    narrow = _path(F.col("volume"), F.col("offset"))["narrow"]
    a = mine.withColumn("narrow", narrow).join(ranges, "narrow", "left_semi")
    b = theirs.withColumn("narrow", narrow).join(ranges, "narrow", "left_semi").select("volume", "offset", "digest", "n_bytes", F.col("page_id").alias("id"), F.col("copies").alias("times"))
    pairs = a.drop("narrow").join(b, ["volume", "offset", "digest", "n_bytes"], "full")
    lone = pairs.filter("times is null or copies is null")
    # Where only one side has the record: what stands at its offset, and elsewhere in its volume, on the other.
    left, right = lone.filter("copies is not null"), lone.filter("copies is null")
    at = right.select("volume", "offset", F.lit(True).alias("taken")).distinct()
    elsewhere = right.select("volume", "digest", F.lit(True).alias("found")).distinct()
    left = left.join(at, ["volume", "offset"], "left").join(elsewhere, ["volume", "digest"], "left")
    status = F.when(F.col("found"), "moved").when(F.col("taken"), "changed").otherwise("missing")
    left = left.select("page_id", "volume", "offset", "n_bytes", "digest", "copies", status.alias("status"))
    here = lone.filter("copies is not null").select("volume", "offset").distinct()
    known = lone.filter("copies is not null").select("volume", "digest").distinct()
    right = right.join(here, ["volume", "offset"], "left_anti").join(known, ["volume", "digest"], "left_anti")
    right = right.select(F.col("id").alias("page_id"), "volume", "offset", "n_bytes", "digest", F.col("times").alias("copies"), F.lit("extra").alias("status"))
    both = pairs.filter("times is not null and copies is not null")
    both = both.select("page_id", "volume", "offset", "n_bytes", "digest", "copies", F.when(F.col("copies") == F.col("times"), "intact").otherwise("copies").alias("status"))
    sound = mine.withColumn("narrow", narrow).join(ranges, "narrow", "left_anti").drop("narrow").withColumn("status", F.lit("intact"))
    return sound.unionByName(left).unionByName(right).unionByName(both).withColumnRenamed("digest", "sha256").select("page_id", "volume", "offset", "n_bytes", "sha256", "copies", "status")


#: The replica that the query audits: by id modulo DAMAGE, a changed character, a blanked end, a lost record, one off its place.
DAMAGE = 97


def damaged(archive: DataFrame) -> DataFrame:
    """A replica of the archive with damage planted by rule; what is not hurt keeps its offset."""
    at = F.pmod(F.col("page_id"), F.lit(DAMAGE))
    record = F.col("record")
    hurt = F.when(at == 7, F.overlay(record, F.lit("#"), 200)).when(at == 11, F.rpad(F.substring(record, F.lit(1), F.length(record) - 20), F.length(record), F.lit("0"))).otherwise(record)
    place = F.when(at == 17, F.col("offset") + 1).otherwise(F.col("offset"))
    return archive.filter(F.coalesce(at != 13, F.lit(True))).select("volume", place.alias("offset"), "page_id", hurt.alias("record"))


def fixity(spark: SparkSession, pages: DataFrame) -> DataFrame:
    archive = Scratch(spark, "archive").keep(lay_out(to_records(pages)), "volumes")
    return audit(archive, damaged(archive)).drop("copies")


def oracle_sql() -> str:
    line = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, coalesce(html, '') AS body, coalesce(url, '') AS url, md5(coalesce(page_id::VARCHAR, '')) AS i FROM pages),
rec AS (SELECT page_id, '{VERSION}' || {line} || 'WARC-Type: resource' || {line} || 'WARC-Record-ID: <urn:uuid:'
  || concat_ws('-', substr(i, 1, 8), substr(i, 9, 4), substr(i, 13, 4), substr(i, 17, 4), substr(i, 21, 12)) || '>' || {line}
  || 'WARC-Target-URI: ' || url || {line} || 'WARC-Date: 2000-01-01T00:00:00Z' || {line} || 'Content-Type: text/html' || {line}
  || 'Content-Length: ' || strlen(body)::VARCHAR || {line} || {line} || body || {line} || {line} AS record FROM r),
h AS (SELECT page_id, strlen(record)::BIGINT AS n_bytes, sha256(record) AS sha256, floor(page_id / {PER_VOLUME}.0)::BIGINT AS span FROM rec),
d AS (SELECT *, ('0x' || substr(sha256, 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY span) / {CROWD * PER_VOLUME}.0)::BIGINT AS part FROM h),
v AS (SELECT *, coalesce(span::VARCHAR, 'none') || '-' || part::VARCHAR AS volume FROM d)
SELECT page_id, volume, coalesce(sum(n_bytes) OVER (PARTITION BY volume ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset, n_bytes, sha256,
  CASE WHEN page_id % {DAMAGE} IN (7, 11) THEN 'changed' WHEN page_id % {DAMAGE} = 13 THEN 'missing' WHEN page_id % {DAMAGE} = 17 THEN 'moved' ELSE 'intact' END AS status
FROM v"""
