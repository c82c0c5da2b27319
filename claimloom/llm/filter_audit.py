"""Filter interaction audit: what each order of five filters would remove, and what it would cost.

Filters A to D are functions of a text; E fails a text that a smaller doc_id has too, anywhere in the
table. E routes fingerprints through RDDs: texts go to the partition of their xxhash, sorted there by
hash and id; the texts of one hash form its collision chain, each whole and with the least id that has it,
and the ids above that fail. As rows arrive in order of id, a chain is all that is held.

Copies are settled where they are read: of a text that a block of rows has more than once only the
least id travels with it, with the number of such rows; the ids above it fail E for certain
and travel without their text, spread by their own hash. So a text of which a third of all rows are
copies moves once a block. combineByKey adds up, for each part, the 2 ** 5 masks of failed filters
(rows, good, toxic); all 120 orders are read from these sums.

Texts are measured first and then move once, into partitions of SORTED bytes at most (if hashes are
even and the session does not ask for more of them), in which sorting could spill. What is held: a block's distinct
texts (BLOCK bytes), a chain, the sums of the parts.

Defined cases: a null text is the empty one; a null doc_id is no smaller id and fails E never, and
has no labels; rows that share a doc_id and a text all pass or all fail E; a document that several labels rows name is
good (toxic) if one of them says so; a null source is the part "", as an empty one; very long texts count whole;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby, permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Bytes of distinct texts, about, after which a reader hands on what it holds.
BLOCK = 32 << 20
#: Bytes of texts in a partition that sorts them, at most about.
SORTED = 64 << 20
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"


def mask_of(text: bytes) -> int:
    """Bit k: whether filter k of A to D fails the text."""
    words = text.split()
    failed = (
        len(words) < 50,
        100 * len(set(words)) < 65 * len(words),
        100 * (len(text) - len(text.translate(None, _CAPITALS))) > 5 * len(text.decode("utf-8", "replace")),
        len(text.translate(None, _SIGNS)) < len(text),
    )
    return sum(1 << k for k, f in enumerate(failed) if f)


Row = tuple[tuple[int, int], tuple[bytes | None, int | None, tuple[tuple[str, int], ...], int]]


def routed(rows: Iterator[tuple], fingerprint: Callable[[bytes], int], block: int) -> Iterator[Row]:
    """((hash, id), (text, id, ((part, rows), ...), mask)) of rows (doc_id, text, part): the texts of least ids, once a block.

    Rows whose mask is final have no text, and a hash of their own.
    """
    chains: dict[int, list[list]] = {}
    final: Counter = Counter()
    held = 0

    def emptied() -> Iterator[Row]:
        for h, chain in chains.items():
            for text, mask, least, parts in chain:
                yield (h, least), (text, least, tuple(parts.items()), mask)
        for (doc_id, part, mask), n in final.items():
            yield (xxhash.xxh3_64_intdigest(f"{doc_id} {mask} {part}".encode()), 0), (None, doc_id, ((part, n),), mask)
        chains.clear()
        final.clear()

    for doc_id, text, part in rows:
        text = bytes(text)
        h = fingerprint(text)
        found = next((x for x in chains.get(h, ()) if x[0] == text), None)
        if doc_id is None:
            final[None, part, found[1] if found else mask_of(text)] += 1
        elif found is None:
            chains.setdefault(h, []).append([text, mask_of(text), doc_id, Counter({part: 1})])
            held += len(text) + 400
        elif doc_id == found[2]:
            found[3][part] += 1
        elif doc_id > found[2]:
            final[doc_id, part, found[1] | COPY] += 1
            held += 200
        else:
            for p, n in found[3].items():
                final[found[2], p, found[1] | COPY] += n
            found[2:] = doc_id, Counter({part: 1})
            held += 200
        if held > block:
            yield from emptied()
            held = 0
    yield from emptied()


def chained(rows: Iterator[Row]) -> Iterator[tuple[int | None, str, int, int]]:
    """(doc_id, part, mask, rows) from rows in order of hash and id."""
    for _, same in groupby(rows, lambda row: row[0][0]):
        chain: list[tuple[bytes, int]] = []
        for _, (text, doc_id, parts, mask) in same:
            if text is not None:
                least = next((i for t, i in chain if t == text), None)
                if least is None:
                    chain.append((text, doc_id))
                elif doc_id > least:
                    mask |= COPY
            for part, n in parts:
                yield doc_id, part, mask, n


def masks(documents: DataFrame, fingerprint: Callable[[bytes], int] = xxhash.xxh3_64_intdigest, block: int = BLOCK) -> DataFrame:
    """doc_id, part, mask, n: how many rows of a doc_id in a part fail just these filters (it may take several rows to say so)."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED))
    rows = documents.select(F.col("doc_id").cast("long"), text, F.coalesce(F.col("source").cast("string"), F.lit(""))).rdd
    sorted_ = rows.mapPartitions(lambda part: routed(part, fingerprint, block)).repartitionAndSortWithinPartitions(n, lambda key: key[0])
    return spark.createDataFrame(sorted_.mapPartitions(chained), "doc_id long, part string, mask int, n long", verifySchema=False)


def vectors(counted: DataFrame, labels: DataFrame) -> RDD:
    """(part, array of rows, good, toxic by mask)."""
    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality"), said("toxic"))
    rows = counted.join(marks, "doc_id", "left").select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("quality", "toxic")))

    def with_row(sums: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        sums[:, mask] += (n, n * good, n * toxic)
        return sums

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: with_row(np.zeros((3, 1 << len(FILTERS)), np.int64), row), with_row, merged)


def orders(part: str, sums: np.ndarray) -> Iterator[tuple]:
    """SCHEMA's rows of a part, from its sums by mask."""
    fails = [(np.arange(1 << len(FILTERS)) >> k & 1).astype(bool) for k in range(len(FILTERS))]
    total = int(sums[0].sum())
    alone = [int(sums[0, 1 << k]) for k in range(len(FILTERS))]
    shapley, rows = [0] * len(FILTERS), []
    for order in permutations(range(len(FILTERS))):
        gone, kept = np.zeros(1 << len(FILTERS), bool), total
        for step, k in enumerate(order, 1):
            here = sums[:, fails[k] & ~gone].sum(1).tolist()
            kept -= here[0]
            shapley[k] += here[0]
            rows.append((order, step, k, kept, here, int(sums[0, fails[k] & gone].sum())))
            gone |= fails[k]
    for order, step, k, kept, (removed, good, toxic), redundant in rows:
        yield part, "".join(FILTERS[i] for i in order), step, kept, removed, redundant, alone[k], good, toxic, shapley[k]


def audit(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """What SCHEMA lists, for every part, order and step."""
    found = vectors(masks(documents, **options), labels).flatMap(lambda x: orders(*x))
    return documents.sparkSession.createDataFrame(found, SCHEMA, verifySchema=False)


def oracle_sql() -> str:
    """The same in DuckDB: masks by windows, orders by joining the letters to themselves."""
    bits = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate((
        "len(w) < 50", "100 * len(list_distinct(w)) < 65 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)",
        "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > least, false)",
    )))
    bit = "(1 << (strpos('ABCDE', {}) - 1))"
    before = f"list_sum(list_transform(string_split(substr(filter_order, 1, step - 1), ''), lambda f: CASE WHEN f = '' THEN 0 ELSE {bit.format('f')} END))"
    letter = "(SELECT unnest(string_split('ABCDE', '')) AS {0}) {0}"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM (SELECT doc_id, part, {bits} AS mask FROM d) LEFT JOIN l USING (doc_id) GROUP BY ALL),
o AS (SELECT a || b || c || d || e AS filter_order FROM {', '.join(letter.format(x) for x in 'abcde')} WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT *, substr(filter_order, step, 1) AS f, {bit.format('substr(filter_order, step, 1)')} AS own, coalesce({before}, 0)::BIGINT AS earlier FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, f, sum(n) FILTER (mask & (own | earlier) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant,
  sum(n) FILTER (mask = own) AS unique_fails, sum(g) FILTER (mask & own > 0 AND mask & earlier = 0) AS good_lost, sum(x) FILTER (mask & own > 0 AND mask & earlier = 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r"""
