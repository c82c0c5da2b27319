"""Toxicity by maximum-scoring segments.

A lexicon gives each word a score in nats: the lower confidence bound of its log-odds between toxic
and clean training texts under a Dirichlet prior (PRIOR pseudo-counts at the background rate).
Words also have prefix features, so that inflected forms never seen are known by their stems; all
other words score DRIFT. A linear-time scan finds every maximal scoring segment of
a text. The scores of chance segments in clean texts follow an extreme-value law whose scale solves
sum p(s) exp(lambda s) = 1 and whose K is fitted on clean texts held back from the lexicon; a text's
segments give one p-value by their ordered sum statistic, and the p-value's Bayes-factor bound with
the share of toxic texts gives the score.

The lexicon is learned from a bounded sample: the SAMPLE labelled rows of smallest hash, near copies
once; all other passes see all rows. Only ids of the sample and the lexicon, which the sample
bounds, are sent around; no text is shuffled, and calibration collects a histogram.

Defined cases: null, empty and wordless texts have no segment and get the toxic share as score;
null ids are in fold 0 and are not learned from; without labels of both classes no word scores and
every score is the share; equal texts, repeated rows too, score alike; very long texts are scanned
whole, in time proportional to their length; empty tables give empty results; extra columns are
ignored (score) or kept (filter).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, arrow_map, bytes_of, crc32_mod, mix64

SAMPLE = 60_000
PREFIXES = (4, 5, 6)
#: Log-odds enter the lexicon beyond ENTRY standard errors (the features tested are many) and score less BOUND of
#: them, LEAST nats at least. PRIOR texts are spread over the classes by the background distribution.
MIN_COUNT, PRIOR, ENTRY, BOUND, LEAST, DRIFT, MOST = 4, 5.0, 3.5, 1.64, 1.0, -0.3, 8.0
SIGNIFICANT = 0.01
THRESHOLD = 0.3
_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_/\\"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_segments long"
SEGMENT_SCHEMA = "doc_id long, start_word long, end_word long, score double, e_value double, passage string"


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; ASCII punctuation at their edges does not count."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return [w.strip(_EDGES) for w in low.split()]


def features_of(word: bytes, ending: int = 1) -> list[bytes]:
    """The word and its prefixes by characters (marked by a blank) that leave an ending so long.

    Counts take endings of two characters or more, so that a stem rests on other words than itself
    with one letter more; scores take one.
    """
    if len(word) <= PREFIXES[0]:
        return [word]
    chars = word.decode("utf-8", "replace")
    return [word, *(chars[:k].encode() + b" " for k in PREFIXES if len(chars) >= k + ending)]


class Scores(dict):
    """word -> score, remembered within a bound."""

    LIMIT = 300_000

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        found = [s for f in features_of(word) if (s := self.lexicon.get(f)) is not None]
        self[word] = out = max(found) if found else DRIFT
        return out


def segments_of(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), after Ruzzo and Tompa, in linear time.

    An open segment keeps the place of the nearest one before it whose left sum is lower; the search
    for such a one jumps from place to place and passes over nothing twice. A segment without any is
    the start of all that can still grow, so what stands before it is final.
    """
    out: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before the start, sum at the end, place of a lower one
    total, at = 0.0, 0
    for i in np.flatnonzero(scores > 0).tolist():
        total += float(scores[at:i].sum())
        low, high, start = total, total + float(scores[i]), i
        total, at = high, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0:
                out += [(a, b, r - l) for a, b, l, r, _ in stack]
                stack = [(start, i + 1, low, high, -1)]
                break
            if stack[j][3] >= high:
                stack.append((start, i + 1, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return out + [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class Model:
    """The lexicon and the calibration of segment scores."""

    lexicon: dict[bytes, float] = field(default_factory=dict)
    share: float = 0.1
    scale: float = 1.0
    log_k: float = -6.0

    def p_value(self, sums: list[float], n: int) -> float:
        """Of the best r segments together, the smallest over r, for a text of n words."""
        best, total = 1.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            total += self.scale * s - self.log_k - math.log(max(n, 1))
            if r == 1:
                p = -math.expm1(-math.exp(min(50.0, -total)))
            elif total <= r:
                break
            else:
                p = math.exp(-total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r) + r * math.log(2))
            best = min(best, p)
        return max(best, 1e-300)

    def score(self, sums: list[float], n: int) -> float:
        p = self.p_value(sums, n) if sums else 1.0
        factor = -math.e * p * math.log(p) if p < 1 / math.e else 1.0
        return self.share / (self.share + (1 - self.share) * factor)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's three-word shingles: near copies mostly share them."""
    hashes = WordHashes()
    for batch in batches:
        low = []
        for text in bytes_of(batch.column("text")):
            h = hashes.of((text or b"").split()) * np.uint64(0x9E3779B97F4A7C15)
            h = (h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(3) + h[2:] if len(h) > 2 else h[:1] if len(h) else np.zeros(1, np.uint64)
            low.append([int(mix64(h ^ np.uint64(salt)).min().astype(np.int64)) for salt in (0, 0x5DEECE66D)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), *(pa.array([x[k] for x in low], pa.int64()) for k in (0, 1))], ["doc_id", "toxic", "a", "b"]
        )


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, toxic, part of the sample: folds 0 and 1 for the lexicon, 3 for calibration."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    fold = crc32_mod(F.col("doc_id"), 4)
    marks = marks.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 2)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(marks), "doc_id")
    sketches = arrow_map(texts, _sketch, "doc_id long, toxic int, a long, b long")
    rows = sketches.groupBy("doc_id", "toxic").agg(F.min("a").alias("a"), F.min("b").alias("b")).collect()  # SAMPLE rows at most
    # A group of near copies is one piece of evidence: of texts that share a sketch the smallest id counts.
    first: dict = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        for k in "ab":
            first.setdefault((k, r.toxic, r[k]), r.doc_id)
    once = sorted({(r.doc_id, r.toxic) for r in rows if all(first[k, r.toxic, r[k]] == r.doc_id for k in "ab")})
    return documents.sparkSession.createDataFrame(once, "doc_id long, toxic int").withColumn("back", fold == 3)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Counter(), Counter()
    texts = [0, 0]
    for batch in batches:
        for text, toxic in zip(bytes_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            y = int(toxic == 1)
            texts[y] += 1
            seen[y].update({f for w in set(words_of(text or b"")) for f in features_of(w, 2)})
    names = list(set(seen[0]) | set(seen[1]))
    yield pa.RecordBatch.from_arrays(
        [pa.array([*names, b" "], pa.binary()), *(pa.array([*(seen[y][f] for f in names), texts[y]], pa.int64()) for y in (0, 1))], ["feature", "clean", "toxic"]
    )


#: Sums over texts held back; tops and logarithms in millionths, so that any order of adding gives the same.
TEXTS, TOXIC, WORDS_SEEN, TOPS, LOGS, TALLY = range(6)


def _statistics(shipped):
    """Rows (kind, value, n) of a partition: what calibration needs of the texts held back.

    TALLY rows count the words of clean texts by their score; the other kinds are sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shipped.value.lexicon)
        sums, tally = [0] * TALLY, Counter()
        for batch in batches:
            for text, toxic in zip(bytes_of(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                sums[TEXTS] += 1
                if toxic:
                    sums[TOXIC] += 1
                    continue
                words = words_of(text or b"")
                x = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
                tally.update(x.round(1).tolist())
                sums[WORDS_SEEN] += len(words)
                sums[TOPS] += round(1e6 * max((s for _, _, s in segments_of(x)), default=0.0))
                sums[LOGS] += round(1e6 * math.log(max(len(words), 1)))
        rows = [(k, 0.0, n) for k, n in enumerate(sums)] + [(TALLY, s, n) for s, n in tally.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.int64()))], ["kind", "value", "n"])

    return run


def _lexicon(counts: DataFrame) -> dict[bytes, float]:
    """Features whose log-odds differ from 0 at the confidence ENTRY, with a lower bound as score."""
    total = counts.filter(F.col("feature") != F.lit(b" ")).agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    texts = counts.filter(F.col("feature") == F.lit(b" ")).first()
    if not texts or not texts.clean or not texts.toxic or not total.c or not total.t:
        return {}
    n0, n1 = float(total.c), float(total.t)
    y0, y1 = F.col("clean") + PRIOR * n0 / (n0 + n1), F.col("toxic") + PRIOR * n1 / (n0 + n1)
    odds = F.log(y1 / (n1 + PRIOR - y1)) - F.log(y0 / (n0 + PRIOR - y0))
    sigma = F.sqrt(1 / y0 + 1 / y1)
    scored = counts.filter((F.col("feature") != F.lit(b" ")) & (F.col("clean") + F.col("toxic") >= MIN_COUNT)).select("feature", odds.alias("odds"), sigma.alias("sigma"))
    positive = scored.filter((F.col("odds") > ENTRY * F.col("sigma")) & (F.col("odds") - BOUND * F.col("sigma") >= LEAST))  # bounded by the sample
    return {bytes(r.feature): min(MOST, r.odds - BOUND * r.sigma) for r in positive.collect()}


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    spark = documents.sparkSession
    marks = _labelled(documents, labels)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    texts = texts.join(F.broadcast(marks), "doc_id")  # SAMPLE rows at most
    counts = arrow_map(texts.filter(~F.col("back")).select("text", "toxic"), _count, "feature binary, clean long, toxic long")
    counts = counts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter((F.col("clean") + F.col("toxic") >= MIN_COUNT) | (F.col("feature") == F.lit(b" "))).persist()
    model = Model(_lexicon(counts))
    counts.unpersist()
    found = arrow_map(texts.filter("back").select("text", "toxic"), _statistics(spark.sparkContext.broadcast(model)), "kind int, value double, n long")
    found = {(r.kind, r.value): r.n for r in found.groupBy("kind", "value").agg(F.sum("n").alias("n")).collect()}  # scores are tenths up to MOST
    of = lambda kind: found.get((kind, 0.0), 0)
    clean, n = of(TEXTS) - of(TOXIC), of(WORDS_SEEN)
    model.share = (of(TOXIC) + 1) / (of(TEXTS) + 10)
    # The scale: the positive root of sum p(s) exp(x s) = 1 over words of clean texts.
    if clean and n:
        tally = sorted((value, count) for (kind, value), count in found.items() if kind == TALLY)
        s, p = np.array([x for x, _ in tally]), np.array([x for _, x in tally], float) / n
        if (s > 0).any() and s @ p < 0:
            lo, hi = 0.0, 4.0
            for _ in range(60):
                x = (lo + hi) / 2
                lo, hi = (x, hi) if p @ np.exp(x * s) < 1 else (lo, x)
            model.scale = float(np.clip(lo, 0.3, 2.0))
        model.log_k = (model.scale * of(TOPS) - of(LOGS)) / 1e6 / clean - 0.5772
    return model


def _scored(texts: Iterator[bytes | None], model: Model, scores: Scores) -> Iterator[tuple[list[bytes], list[tuple[int, int, float]], float]]:
    for text in texts:
        words = words_of(text or b"")
        x = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
        found = segments_of(x)
        yield words, found, model.score([s for _, _, s in found], len(words))


def score(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """What SCHEMA lists, for every document; n_segments counts the significant passages."""
    shipped = documents.sparkSession.sparkContext.broadcast(model or fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        scores = Scores(known.lexicon)
        for batch in batches:
            value, count = [], []
            for words, found, s in _scored(bytes_of(batch.column("text")), known, scores):
                value.append(s)
                count.append(sum(known.p_value([x], len(words)) <= SIGNIFICANT for _, _, x in found))
            predicted = [int(s >= THRESHOLD) for s in value]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value, pa.float64()), pa.array(predicted, pa.int32()), pa.array(count, pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_segments"],
            )

    held = (crc32_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("binary").alias("text")), run, SCHEMA)


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """SEGMENT_SCHEMA: every significant passage, with its words."""
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        scores = Scores(known.lexicon)
        for batch in batches:
            rows = []
            for i, (words, found, _) in zip(batch.column("doc_id").to_pylist(), _scored(bytes_of(batch.column("text")), known, scores), strict=True):
                for a, b, s in found:
                    if known.p_value([s], len(words)) <= SIGNIFICANT:
                        e = math.exp(min(700.0, known.log_k + math.log(len(words)) - known.scale * s))
                        rows.append((i, a, b, s, e, b" ".join(words[a:b]).decode("utf-8", "replace")))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
            names = ["doc_id", "start_word", "end_word", "score", "e_value", "passage"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, SEGMENT_SCHEMA)


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below THRESHOLD, whole and with all their columns."""
    shipped = documents.sparkSession.sparkContext.broadcast(fit(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        scores = Scores(known.lexicon)
        for batch in batches:
            keep = [s < THRESHOLD for _, _, s in _scored(bytes_of(batch.column("text")), known, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(documents, run, documents.schema)
