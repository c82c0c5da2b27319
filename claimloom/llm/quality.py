"""Quality rules under weak supervision.

Each rule votes or abstains: some vote bad where they find a defect, others good where they find a
sign of good text. Expectation-maximisation over the counts of vote patterns (at most 2 ** rules of
them, whatever the corpus) estimates, for good and for bad documents, how often each rule votes and
abstains, and the share of good documents. It is run from several starts, of which the likeliest end
counts. A rule that turns out to vote against its kind no less than for it says nothing. A document is kept if its posterior
probability of being good reaches one half and it passes the base rules.

To report verdicts, texts are analysed once: facts and vote patterns are written to a table, the
patterns counted, and the verdicts looked up by pattern. To filter, they are analysed twice, which costs less than
a second copy of them. No shuffle moves text.

Defined cases: a null text has no words and fails the base rules; equal texts, repeated rows too,
get equal verdicts; very long texts are analysed whole; an empty table gives an empty result; extra
input columns are ignored (op) or kept (filter).
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_map, bytes_of, mix64

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"
WINDOW = 8
_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
ABSTAIN, BAD, GOOD = 0, 1, 2


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that occur twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
    _, at, count = np.unique(mix64(keys), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[at] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Facts:
    """Counts of one text, from its UTF-8 bytes."""

    __slots__ = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "top_word", "stutters", "upper", "lower", "bangs")

    def __init__(self, text: bytes, hashes: WordHashes):
        words = text.split()
        solid = text.translate(None, _SPACE)
        self.n_words = len(words)
        self.word_chars = len(solid.decode("utf-8", "replace"))
        self.n_symbols = len(solid) - len(solid.translate(None, _SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        self.n_lines, self.n_dup_lines = len(lines), len(lines) - len(set(lines))
        self.n_repeat_words = repeated_words(hashes.of(words))
        self.top_word = max(Counter(words).values(), default=0)
        self.stutters = sum(map(operator.eq, words, words[1:]))
        self.upper = len(solid) - len(solid.translate(None, _UPPER))
        self.lower = len(solid) - len(solid.translate(None, _LOWER))
        self.bangs = solid.count(b"!")

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


#: Rules that look for one defect each, and abstain where they do not find it. Each sees a text of one word at least.
DEFECTS = {
    "short": lambda f: f.n_words < 20,
    "symbols": lambda f: f.n_symbols > 0.3 * f.n_words,
    "duplicate_lines": lambda f: f.n_lines > 3 and f.n_dup_lines > 0.3 * f.n_lines,
    "repetition": lambda f: f.n_repeat_words > 0.3 * f.n_words,
    "word_length": lambda f: not 1.5 <= f.word_chars / f.n_words <= 20,
    "one_word": lambda f: f.n_words >= 20 and f.top_word > 0.35 * f.n_words,
    "stutter": lambda f: f.n_words >= 20 and f.stutters > 0.3 * f.n_words,
    "capitals": lambda f: f.upper + f.lower >= 20 and f.upper > 0.6 * (f.upper + f.lower),
    "exclamation": lambda f: f.bangs > 0.4 * f.n_words,
}
#: Rules that look for a sign of good text, and abstain where they do not find it.
SIGNS = {
    "long_enough": lambda f: f.n_words >= 50,
    "plain": lambda f: f.n_symbols < 0.05 * f.n_words and f.bangs < 0.1 * f.n_words,
    "varied": lambda f: f.n_words >= 20 and f.top_word < 0.15 * f.n_words and f.n_repeat_words < 0.05 * f.n_words,
    "words": lambda f: 2.5 <= f.word_chars / f.n_words <= 12,
}
RULES = [(rule, BAD) for rule in DEFECTS.values()] + [(rule, GOOD) for rule in SIGNS.values()]


def pattern_of(facts: Facts) -> int:
    """All votes as one number in base 3."""
    out = 0
    for rule, vote in RULES:
        out = 3 * out + (vote if facts.n_words and rule(facts) else ABSTAIN)
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    m = len(RULES)
    return patterns[:, None] // 3 ** np.arange(m - 1, -1, -1) % 3


#: For bad and for good documents, the votes (abstain, bad, good) of each rule before any is seen, which count as PRIOR_VOTES.
_OF_DEFECTS, _OF_SIGNS = [[0.7, 0.3, 0.0], [0.995, 0.005, 0.0]], [[0.6, 0.0, 0.4], [0.15, 0.0, 0.85]]
PRIOR, PRIOR_VOTES = np.array([_OF_DEFECTS if vote == BAD else _OF_SIGNS for _, vote in RULES]).transpose(1, 0, 2), 10.0
#: A rule finds its defect in so many good documents at most. Defects seldom come together, so that agreement alone would
#: not tell a rare defect from a rare but good kind of text.
FALSE = 0.005
#: Shares of good documents from which the estimation starts.
STARTS = (0.5, 0.8, 0.95)


def _log(table: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(table, 1e-300))


class LabelModel:
    """Share of good documents and, for each class and rule, the probabilities of its votes."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 500):
        cast = (votes_of(patterns)[:, :, None] == np.arange(3)).astype(float)  # pattern, rule, vote
        ends = [self._estimate(cast, counts, share, rounds) for share in STARTS] if counts.sum() else [(0.0, 0.8, PRIOR)]
        best = max(end[0] for end in ends)
        _, self.share, self.votes = next(end for end in ends if end[0] >= best - 1e-6 * abs(best))

    @staticmethod
    def _estimate(cast: np.ndarray, counts: np.ndarray, share: float, rounds: int) -> tuple[float, float, np.ndarray]:
        """Log-posterior, share of good documents and probabilities (class, rule, vote) where it ends."""
        total, before, table = counts.sum(), -np.inf, PRIOR
        for _ in range(rounds):
            joint = np.einsum("prv,crv->pc", cast, _log(table)) + np.log([1 - share, share])
            top = joint.max(1)
            whole = top + np.log(np.exp(joint - top[:, None]).sum(1))
            now = whole @ counts + PRIOR_VOTES * (PRIOR * _log(table)).sum() + 2 * np.log(1 - share) + 8 * np.log(share)
            if now - before < 1e-10 * abs(now):
                break
            before = now
            weight = np.exp(joint - whole[:, None]) * counts[:, None]
            seen = np.einsum("pc,prv->crv", weight, cast)
            table = (seen + PRIOR_VOTES * PRIOR) / (seen.sum(2, keepdims=True) + PRIOR_VOTES)
            over = table[1, :, BAD] > FALSE
            table[1, over] = [1 - FALSE, FALSE, 0.0]
            idle = (table[0, :, BAD] < table[1, :, BAD]) | (table[0, :, GOOD] > table[1, :, GOOD])
            table[:, idle] = (seen.sum(0) + PRIOR_VOTES * PRIOR.mean(0))[idle] / (total + PRIOR_VOTES)
            share = (weight[:, 1].sum() + 8) / (total + 10)
        return now, share, table

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of being good."""
        by_rule = _log(self.votes)[:, np.arange(len(RULES)), votes].sum(2)
        bad, good = by_rule + np.log([[1 - self.share], [self.share]])
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _analyse(batches: Iterator[pa.RecordBatch], keep: list[str], counts: tuple[str, ...], failed: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Columns keep, the counts named, whether the base rules fail, and the vote pattern."""
    hashes = WordHashes()
    for batch in batches:
        facts = [Facts(t or b"", hashes) for t in bytes_of(batch.column("text"))]
        columns = [pa.array([getattr(f, n) for f in facts], pa.int64()) for n in counts]
        columns += [pa.array([f.base_failed for f in facts], pa.bool_()), pa.array(map(pattern_of, facts), pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *counts, failed, pattern])


def posteriors(profiles: DataFrame, pattern: str) -> dict[int, float]:
    """Posterior quality of every vote pattern that occurs: 2 ** len(RULES) at most."""
    rows = profiles.groupBy(pattern).agg(F.count(F.lit(1)).alias("n")).orderBy(pattern).collect()
    patterns, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
    return dict(zip(patterns.tolist(), LabelModel(patterns, counts).posterior(votes_of(patterns)).tolist(), strict=True))


def _with_quality(profiles: DataFrame, pattern: str, quality: str) -> DataFrame:
    """profiles with the posterior of each row's pattern, from a broadcast table of 2 ** len(RULES) rows at most."""
    table = profiles.sparkSession.createDataFrame(list(posteriors(profiles, pattern).items()), f"`{pattern}` long, `{quality}` double")
    return profiles.join(F.broadcast(table), pattern)


def judge(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """What SCHEMA lists, for every document."""
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in COUNTS) + ", base_failed boolean, pattern long"
    profiles = Scratch(documents.sparkSession, "quality").keep(arrow_map(slim, lambda bs: _analyse(bs, ["doc_id"], COUNTS, "base_failed", "pattern"), schema), "profiles")
    kept = (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept")
    return _with_quality(profiles, "pattern", "quality").select("doc_id", *COUNTS, "base_failed", kept, "quality")


def _kept(batches: Iterator[pa.RecordBatch], quality: dict[int, float], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each batch that are good: analysed again, so that nothing but pattern counts is kept of the first look."""
    hashes = WordHashes()
    for batch in batches:
        facts = (Facts(t or b"", hashes) for t in bytes_of(batch.column("text")))
        good = pa.array([not f.base_failed and quality[pattern_of(f)] >= threshold for f in facts], pa.bool_())
        yield batch.filter(good)


def keep_good(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept, whole and with all their columns.

    Texts are looked at twice, for the counts of patterns and to judge them by the model, and written by neither.
    """
    slim = documents.select(F.col("text").cast("binary").alias("text"))
    profiles = arrow_map(slim, lambda bs: _analyse(bs, [], (), "base_failed", "pattern"), "base_failed boolean, pattern long")
    quality = posteriors(profiles, "pattern")
    return arrow_map(documents, lambda bs: _kept(bs, quality, threshold), documents.schema)
