"""Language-model scores: Katz backoff over trigrams, with Good-Turing discounts.

P(w | h) = d(c) c(h, w) / c(h)     for n-grams seen in the training texts,
           alpha(h) P(w | h')      else, h' being h without its first word,
with d of each order up to K from its counts of counts, smoothed by a power law, and 1 above, and alpha(h) the mass that h's
seen n-grams leave over the mass of the words not seen after h, so that every history's
probabilities sum to 1 exactly. A history after which only frequent words were seen leaves nothing:
it gets one more, unseen, occurrence. P(w) is the add-one-half unigram, which has a share for unknown
words and ends the recursion. Each token is looked up at its highest order and backs off from there;
a text's first token has a history of one word, its start.

Texts are packed into blocks: distinct word hashes, and the texts as places among them. A block asks
for the counts of its distinct pairs once, by bucket of the second word; the bucket adds up c(h, w)
and c(w) over all blocks and answers in the order asked. Sums per history go by bucket of the
history, in the same way. Then blocks ask for their triples by bucket of the history, with P(w | v)
of those seen; but a pair that stands in one block only is the history of triples of that block
only, and these are settled in it without asking. The tables of counts are spread by hash and
written to the shared folder, so that lost executors cost no more than their tasks; a block needs
memory for its own n-grams only, and a bucket for about BUCKET_TOKENS.

A word or pair that would fill more than HOT of a bucket is spread over several: the sums of such
histories, HOT_MOST at most, are added up apart and sent to all. Lower-order probabilities and
the alphas of words are kept in 32 bits, in all places alike. Words are told apart by 56 bits of their hash everywhere;
a message of triples lists its distinct words once. Messages are one for each block and bucket,
their number the product of both; both hold a fixed number of tokens.

Defined cases: null, empty and wordless texts are one end token; null ids are trained on (fold 0);
without training texts every token has P = 1 (the unknown share is all there is); repeated rows are
texts of their own; very long texts are blocks of their own; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, arrow_map, batch_words, bytes_of, crc32_mod, give_back, mix64

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Counts above K are not discounted.
K = 7
#: Tokens of a block, whose arrays take some 200 bytes a token while it is scored; and of a bucket.
BLOCK_TOKENS, BUCKET_TOKENS = 800_000, 1_500_000
PARTS = 2
HOT, HOT_MOST, SAMPLE = 0.25, 20_000, 20_000
#: No word holds a line end: these stand for a text's end and for what is before its first word.
END, START = b"\n", b"\n\n"
MESSAGE = "kind int, bucket long, block long, a binary, b binary, c binary, d binary, e binary"
_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), *((x, pa.binary()) for x in "abcde")])
TEXTS, PAIRS, COUNTS, HISTORIES, SUMS, MASSES, TOTALS, KNOWN, TRIPLES, FOUND, SPREAD = range(11)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Sums of probabilities in whole numbers, so that any order of adding gives the same.
_UNIT = float(1 << 52)


@cache
def _packer(level: int) -> zstandard.ZstdCompressor:
    """One a process, used for all its messages."""
    return zstandard.ZstdCompressor(level=level)


@cache
def _unpacker() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def pack(x: np.ndarray, level: int = 1) -> bytes:
    return _packer(level).compress(np.ascontiguousarray(x).tobytes())


def unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unpacker().decompress(x), kind)


def _planes(x: np.ndarray, level: int = 1) -> bytes:
    """Non-negative integers: how many bytes the largest takes, then byte plane by byte plane."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    if width == 1:
        return b"\1" + pack(x.astype(np.uint8), level)
    kind = "<u2" if width == 2 else "<u4" if width <= 4 else "<u8"
    return bytes([width]) + pack(x.astype(kind).view(np.uint8).reshape(len(x), -1)[:, :width].T, level)


def _from_planes(x: bytes) -> np.ndarray:
    planes = unpack(memoryview(x)[1:], np.uint8).reshape(x[0], -1)
    out = planes[0].astype(np.int64)
    for k in range(1, x[0]):
        out |= planes[k].astype(np.int64) << 8 * k
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(x, return_inverse=True) of non-negative integers, by one sort of values and places in the same 64 bits: about twice as fast.

    If both don't fit, the values' lowest bits stay out; should that leave some out of order, np.unique sorts them.
    """
    if not len(x):
        return x, np.zeros(0, np.int64)
    places = len(x).bit_length()
    cut = max(0, int(x.max()).bit_length() + places - 64)
    packed = x.astype(np.uint64)
    if cut:
        packed >>= np.uint64(cut)
    packed <<= np.uint64(places)
    packed |= np.arange(len(x), dtype=np.uint64)
    packed.sort()
    at = (packed & np.uint64((1 << places) - 1)).view(np.int64)
    if cut:
        found = x[at]
        if (found[1:] < found[:-1]).any():
            return np.unique(x, return_inverse=True)
    else:
        packed >>= np.uint64(places)
        found = packed.view(x.dtype)
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    of = np.cumsum(new)
    of -= 1
    inverse = np.empty(len(x), np.int64)
    inverse[at] = of
    return found[new], inverse


def _bytes(x: np.ndarray, low: int, high: int) -> bytes:
    """Some of the 8 bytes of hashes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, low:high]).tobytes()


def _from_bytes(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(x) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(x, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def _listed(words: np.ndarray, places: np.ndarray) -> bytes:
    """words[places], each distinct word once."""
    used, at = _distinct(places)
    return len(used).to_bytes(4, "little") + _bytes(words[used], 0, 7) + _planes(at)


def _from_listed(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and the places of all in them."""
    end = 4 + 7 * int.from_bytes(x[:4], "little")
    return _from_bytes(x[4:end], 7), _from_planes(x[end:])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def words_of(words: list[bytes]) -> np.ndarray:
    """Hashes of words as they are used here, of 56 bits."""
    return WordHashes().of(words) >> np.uint64(8)


def _starts(runs: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, runs[1:] != runs[:-1])) if len(runs) else np.zeros(0, np.int64)


def _grouped(tables):
    """For applyInArrow: the group's messages by block; memory goes back when the group is done."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        del table
        rows.sort(key=lambda m: m["block"])
        out = tables(rows)
        rows.clear()
        give_back()
        return out

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """TEXTS: a = word hashes, b = texts as places in a, c = lengths, d = ids and which are null, e = held out."""
    nth, base = 0, TaskContext.get().partitionId() << 32
    end = words_of([END])
    ids: list[tuple[int, bool]] = []
    held: list[bool] = []
    texts: list[np.ndarray] = []
    #: The different words of each batch; texts are places among all of them, the end's is 0.
    lists, listed = [end], 1
    size = 0

    def flush() -> pa.RecordBatch:
        words, at = _distinct(np.concatenate(lists))
        places = at[np.concatenate(texts)]
        count = np.bincount(places, minlength=len(words))
        order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.array([len(x) for x in texts], np.int64)
        return _rows([(TEXTS, 0, base + nth, _bytes(words[order], 0, 7), _planes(rank[places], level=3), pack(lengths), pack(np.array(ids, np.int64)), pack(np.array(held, np.uint8)))])

    for batch in batches:
        different, places, ends = batch_words(batch.column("text"))
        different, places = different >> np.uint64(8), places.astype(np.int64)
        lists.append(different)
        for i, out, lo, hi in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            ids.append((i or 0, i is None))
            held.append(out)
            texts.append(np.append(places[lo:hi] + listed, 0))
            size += hi - lo + 1
            if size >= BLOCK_TOKENS:
                yield flush()
                ids, held, texts, size, nth = [], [], [], 0, nth + 1
                lists, listed = [end, different], 1
        listed += len(different)
    if ids:
        yield flush()


class Block:
    """A block's words and texts, and its distinct pairs and triples."""

    def __init__(self, m: dict):
        self.words, self.tokens, self.lengths = _from_bytes(m["a"], 7), _from_planes(m["b"]), unpack(m["c"], np.int64)
        held = unpack(m["e"], np.uint8).astype(bool)
        self.n = n = len(self.words)
        self.starts = np.append(0, np.cumsum(self.lengths)[:-1])
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = n  # START
        #: Words in codes of pairs and triples take so many bits.
        self.bits = n.bit_length()
        codes, self.pair = _distinct(self.tokens << self.bits | before)
        #: Of each distinct pair the second word and the first; pairs are in that order.
        self.second, self.first = codes >> self.bits, codes & ((1 << self.bits) - 1)
        self.trained = np.repeat(~held, self.lengths)
        self.names = np.append(self.words, words_of([START]))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.trained], minlength=len(self.second))

    def deal_pairs(self, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs by bucket, in order, and where each bucket's begin."""
        bucket = (self.words % np.uint64(buckets))[self.second]
        spread = np.isin(self.words, hot)[self.second]
        if spread.any():
            bucket[spread] = pair_name(self.names[self.first[spread]], self.words[self.second[spread]]) % np.uint64(buckets)
        return _dealt(bucket, buckets)

    def histories(self) -> np.ndarray:
        """A 64-bit name of each distinct pair as a history."""
        return pair_name(self.names[self.first], self.words[self.second])

    def triples(self) -> None:
        """Distinct triples: the history's pair, the word; each token's triple (the tokens but each text's first); counts."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.starts] = False
        self.inner = np.flatnonzero(inner)
        codes, self.triple = _distinct(self.pair[self.inner - 1] << self.bits | self.tokens[self.inner])
        self.history, self.word = codes >> self.bits, codes & ((1 << self.bits) - 1)
        self.triple_counts = np.bincount(self.triple[self.trained[self.inner]], minlength=len(codes))
        #: The pair of each triple's last two words.
        self.lower = np.empty(len(codes), np.int64)
        self.lower[self.triple] = self.pair[self.inner]

    def deal_triples(self, asked: np.ndarray, names: np.ndarray, buckets: int, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The triples asked for, by bucket, in order."""
        name = names[self.history[asked]]
        bucket = name % np.uint64(buckets)
        if hot:
            known = np.fromiter(hot, np.uint64, len(hot))
            for h in np.intersect1d(names, known).tolist():
                at = name == np.uint64(h)
                bucket[at] = (bucket[at] + mix64(self.words[self.word[asked[at]]]) % np.uint64(hot[h])) % np.uint64(buckets)
        return _dealt(bucket, buckets)


def pair_name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _GOLD + second)


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # numpy sorts the short ones by radix
    order = np.argsort(bucket, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def _ask_pairs(buckets: int, hot: np.ndarray):
    """PAIRS: a = second words, b = pairs of each, c = first words, d = counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                x = Block(m)
                count, rows = x.pair_counts(), []
                order, cuts = x.deal_pairs(buckets, hot)
                for k in range(buckets):
                    p = order[cuts[k] : cuts[k + 1]]
                    if len(p):
                        starts = _starts(x.second[p])
                        rows.append((PAIRS, k, m["block"], _bytes(x.words[x.second[p[starts]]], 0, 7), _planes(np.diff(np.append(starts, len(p)))), _bytes(x.names[x.first[p]], 0, 7), _planes(count[p]), None))
                    if len(rows) >= 256:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return run


def _totals(hot: np.ndarray):
    """Training counts of the hot words, of tokens and of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(hot) + 2, np.int64)
        for batch in batches:
            for m in batch.to_pylist():
                words, tokens, lengths = _from_bytes(m["a"], 7), _from_planes(m["b"]), unpack(m["c"], np.int64)
                trained = ~unpack(m["e"], np.uint8).astype(bool)
                tokens = tokens[np.repeat(trained, lengths)]
                of_word = np.bincount(tokens, minlength=len(words))
                at = np.flatnonzero(np.isin(words, hot))
                total[np.searchsorted(hot, words[at])] += of_word[at]
                total[-2:] += len(tokens), int(trained.sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "n"])

    return run


def counts_of_counts(total: np.ndarray) -> np.ndarray:
    """How many have each count, from 0 to K + 1."""
    return np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]


def _add_pairs(buckets: int, hot: np.ndarray, hot_counts: np.ndarray, often: int):
    """Answers (COUNTS: a = of pairs, doubled, and 1 more if other blocks have the pair too; b = of second words), SUMS by history,
    and TOTALS (d: counts of counts, words; a, b: names of pairs that occur often, and how often)."""

    def tables(rows: list[dict]) -> pa.Table:
        bucket = rows[0]["bucket"]
        words = [_from_bytes(m["a"], 7) for m in rows]
        runs = [_from_planes(m["b"]) for m in rows]
        known, word = _distinct(np.concatenate(words))
        second = np.repeat(word, np.concatenate(runs))
        first = np.concatenate([_from_bytes(m["c"], 7) for m in rows])
        count = np.concatenate([_from_planes(m["d"]) for m in rows])
        firsts, at_first = _distinct(first)
        pair = second * len(firsts) + at_first
        del firsts, at_first
        codes, group = _distinct(pair)
        total = np.bincount(group, count, len(codes)).astype(np.int64)
        shared = np.bincount(group) > 1
        heads = np.empty(len(codes), np.int64)
        heads[group] = np.arange(len(group))  # any of them
        del pair, codes
        of_word = np.bincount(second[heads], total, len(known)).astype(np.int64)
        is_hot = np.isin(known, hot)
        if is_hot.any():
            at = dict(zip(hot.tolist(), hot_counts.tolist(), strict=True))
            of_word[is_hot] = [at[w] for w in known[is_hot].tolist()]
        out, at_word, at_pair, answer = [], 0, 0, 2 * total + shared
        for m, w, r in zip(rows, words, runs, strict=True):
            n, p = len(w), int(r.sum())
            out.append((COUNTS, bucket, m["block"], _planes(answer[group[at_pair : at_pair + p]]), _planes(of_word[word[at_word : at_word + n]]), None, None, None))
            at_word, at_pair = at_word + n, at_pair + p
        del words, runs, word, group, count
        frequent = heads[total >= often]
        names, times = pair_name(first[frequent], known[second[frequent]]), total[total >= often]
        seen = np.flatnonzero(total)
        name, class_ = first[heads[seen]], np.minimum(total[seen], K + 1)
        key, at = _distinct(name * np.uint64(K + 2) + class_.astype(np.uint64))
        # name * (K + 2) + class stays below 2 ** 60: names have 56 bits.
        mass = np.bincount(at, 2.0 * of_word[second[heads[seen]]] + 1, len(key)).astype(np.int64)
        sums = np.bincount(at, total[seen], len(key)).astype(np.int64)
        del first, second, heads, seen, at
        name, class_ = key // np.uint64(K + 2), (key % np.uint64(K + 2)).astype(np.uint8)
        order, cuts = _dealt(name % np.uint64(buckets), buckets)
        for k in range(buckets):
            p = order[cuts[k] : cuts[k + 1]]
            if len(p):
                out.append((SUMS, k, -1, _bytes(name[p], 0, 7), pack(class_[p]), _planes(sums[p]), _planes(mass[p]), None))
        out.append((TOTALS, -1, -1, names.tobytes(), times.tobytes(), None, np.append(counts_of_counts(total), ((of_word > 0) & ~is_hot).sum()).astype(np.int64).tobytes(), None))
        return pa.Table.from_batches([_rows(out)])

    return _grouped(tables)


def slope(counts: np.ndarray) -> float:
    """b of the likeliest n(r) ~ r ** b over r = 1 to K + 1, each n(r) being half a n-gram more than counted."""
    x, n = np.log(np.arange(1, K + 2)), counts[1 : K + 2] + 0.5
    mean, low, high = n @ x / n.sum(), -64.0, 64.0
    for _ in range(60):  # the mean of log r rises with b
        b = (low + high) / 2
        w = np.exp(b * x - max(b * x[-1], 0.0))
        low, high = (b, high) if w @ x < mean * w.sum() else (low, b)
    return (low + high) / 2


def discounts(counts: np.ndarray) -> np.ndarray:
    """d(0) to d(K + 1) by Good and Turing, Katz's form, from smoothed counts of counts; 1 above K.

    With n(r) = a r ** b, r * / r = ((r + 1) / r) ** (b + 1), and (K + 1) n(K + 1) / n(1) = (K + 1) ** (b + 1): d
    rises with r and stays between 0 and 1 for every b.
    """
    r, c = np.arange(1, K + 1), slope(counts) + 1
    if abs(c) < 1e-6:  # the limit
        d = 1 - np.log((r + 1) / r) / np.log(K + 1)
    else:
        d = (((r + 1) / r) ** c - (K + 1.0) ** c) / (1 - (K + 1.0) ** c)
    return np.concatenate([[0.0], d, [1.0]])


def _ask_histories(buckets: int):
    """HISTORIES: a = names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a in zip(batch.column("block").to_pylist(), bytes_of(batch.column("a")), strict=True):
                names = np.append(_from_bytes(a, 7), words_of([START]))
                order, cuts = _dealt(names % np.uint64(buckets), buckets)
                yield _rows([(HISTORIES, k, block, _bytes(names[order[cuts[k] : cuts[k + 1]]], 0, 7), None, None, None, None) for k in range(buckets) if cuts[k] < cuts[k + 1]])

    return run


def _add_histories(d: np.ndarray):
    """MASSES: a = discounted counts of a history's seen pairs, b = twice the words' counts plus 1 each."""

    def tables(rows: list[dict]) -> pa.Table:
        sums = [m for m in rows if m["kind"] == SUMS]
        name = np.concatenate([np.zeros(0, np.uint64), *(_from_bytes(m["a"], 7) for m in sums)])
        class_ = np.concatenate([np.zeros(0, np.uint8), *(unpack(m["b"], np.uint8) for m in sums)])
        count = np.concatenate([np.zeros(0, np.int64), *(_from_planes(m["c"]) for m in sums)])
        mass = np.concatenate([np.zeros(0, np.int64), *(_from_planes(m["d"]) for m in sums)])
        known, at = _distinct(name)
        kept = _kept(at, class_, count, len(known), d)
        kept, mass = np.append(kept, 0), np.append(np.bincount(at, mass, len(known)), 0)
        out = []
        for m in rows:
            if m["kind"] == HISTORIES:
                asked = _from_bytes(m["a"], 7)
                place = np.searchsorted(known, asked)
                place[(place == len(known)) | (np.append(known, 0)[place] != asked)] = len(known)
                out.append((MASSES, m["bucket"], m["block"], pack(kept[place]), pack(mass[place]), None, None, None))
        return pa.Table.from_batches([_rows(out)])

    return _grouped(tables)


def _by_class(at: np.ndarray, class_: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, K + 2): of each of n histories, the occurrences of what was seen after it, by how often each was seen."""
    return np.bincount(at * (K + 2) + class_, count, n * (K + 2)).reshape(n, K + 2)


def _kept(at: np.ndarray, class_: np.ndarray, count: np.ndarray, n: int, d: np.ndarray) -> np.ndarray:
    return _by_class(at, class_, count, n) @ d


class Level:
    """What histories of one order give: their occurrences, one more where nothing is left, and alpha."""

    def __init__(self, total: np.ndarray, kept: np.ndarray, rest: np.ndarray, d: np.ndarray):
        """kept: discounted occurrences of what was seen after it; rest: 1 less the lower order's mass of that."""
        self.d, self.total = d, total + ((total > 0) & (kept == total))
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = (1 - kept / self.total) / rest
        self.alpha = np.where(total > 0, alpha, 1.0)

    def p(self, count: np.ndarray, history: np.ndarray, lower: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            own = self.d[np.minimum(count, K + 1)] * count / self.total[history]
        return np.where(count > 0, own, self.alpha[history] * lower)


class Unigram:
    def __init__(self, n: int, v: int, texts: int):
        self.n, self.texts, self.whole = n, texts, n + 0.5 * (v + 1)

    def p(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / self.whole


_KNOWN = "block long, a binary, b binary, c binary, d binary, e binary, pairs binary, words binary, alphas binary, totals binary"


def _know(buckets: int, hot: np.ndarray, unigram: Unigram, d: np.ndarray):
    """A block with the counts of its pairs (as answered) and words, and what its words give as histories."""

    def tables(rows: list[dict]) -> pa.Table:
        m = next(r for r in rows if r["kind"] == TEXTS)
        x = Block(m)
        order, cuts = x.deal_pairs(buckets, hot)
        to, at = _dealt(x.names % np.uint64(buckets), buckets)
        pair, word = np.zeros(len(x.second), np.int64), np.zeros(x.n, np.int64)
        kept, mass = np.zeros(x.n + 1), np.zeros(x.n + 1)
        for r in rows:
            k = r["bucket"]
            if r["kind"] == COUNTS:
                p = order[cuts[k] : cuts[k + 1]]
                pair[p] = _from_planes(r["a"])
                word[x.second[p[_starts(x.second[p])]]] = _from_planes(r["b"])
            elif r["kind"] == MASSES:
                p = to[at[k] : at[k + 1]]
                kept[p], mass[p] = unpack(r["a"], np.float64), unpack(r["b"], np.float64)
        level = Level(np.append(word, unigram.texts), kept, 1 - mass / 2 / unigram.whole, d)
        columns = [m["block"], *(m[c] for c in "abcde"), _planes(pair), _planes(word), pack(level.alpha.astype(np.float32)), _planes(level.total)]
        return pa.table([pa.array([v], pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(columns)], names=[c.split()[0] for c in _KNOWN.split(", ")])

    return _grouped(tables)


class Known(Block):
    """A block that knows its pairs: counts, which of them other blocks have too, and P(w | v) in 32 bits."""

    def __init__(self, m: dict, unigram: Unigram, d: np.ndarray):
        super().__init__(m)
        answer, self.word_counts = _from_planes(m["pairs"]), _from_planes(m["words"])
        self.pair_total, self.shared = answer >> 1, (answer & 1).astype(bool)
        level = Level(np.zeros(0), np.zeros(0), np.zeros(0), d)
        level.alpha, level.total = unpack(m["alphas"], np.float32).astype(np.float64), _from_planes(m["totals"])
        self.base = unigram.p(self.word_counts)
        self.p2 = level.p(self.pair_total, self.first, self.base[self.second])
        self.p2_short = self.p2.astype(np.float32)
        self.triples()
        self.asked = np.flatnonzero(self.shared[self.history])

    def own(self) -> np.ndarray:
        """The triples that no other block can have."""
        return np.flatnonzero(~self.shared[self.history])


def _ask_triples(buckets: int, hot: dict[int, int], unigram: Unigram, d: np.ndarray):
    """TRIPLES: a = histories, b = triples of each, c = words, d = counts, e = P(w | v) of those with a count.

    TOTALS: d = counts of counts of the triples that the block settles by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m in batch.to_pylist():
                x = Known(m, unigram, d)
                names, rows = x.histories(), []
                order, cuts = x.deal_triples(x.asked, names, buckets, hot)
                for k in range(buckets):
                    p = x.asked[order[cuts[k] : cuts[k + 1]]]
                    if len(p):
                        starts, count = _starts(x.history[p]), x.triple_counts[p]
                        short = x.p2_short[x.lower[p[count > 0]]]
                        rows.append((TRIPLES, k, m["block"], _bytes(names[x.history[p[starts]]], 1, 8), _planes(np.diff(np.append(starts, len(p)))), _listed(x.words, x.word[p]), _planes(count), short.tobytes()))
                    if len(rows) >= 256:
                        yield _rows(rows)
                        rows = []
                rows.append((TOTALS, m["block"] % buckets, -1, None, None, None, counts_of_counts(x.triple_counts[x.own()]).astype(np.int64).tobytes(), None))
                yield _rows(rows)

    return run


def _backs_off(count: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each history, whose triples begin at starts, whether one of them was never seen."""
    return np.logical_or.reduceat(count == 0, starts)


def _add_triples(hot: dict[int, int]):
    """FOUND: a = counts of the triples; of each history after which one of them was never seen, b = the occurrences by class, c = 1 less
    P(w | v) of what was seen; d = bits of histories after which only frequent words were seen.

    SPREAD: the same of hot histories, as far as this bucket has them: a = names, b = occurrences by class, c = the sum of P(w | v).
    TOTALS: d = counts of counts.
    """
    known_hot = np.sort(np.fromiter(hot, np.uint64, len(hot)) >> np.uint64(8))

    def tables(rows: list[dict]) -> pa.Table:
        counts = np.zeros(K + 2, np.int64)
        for m in rows:
            if m["kind"] == TOTALS:
                counts += np.frombuffer(m["d"], np.int64)
        rows = [m for m in rows if m["kind"] == TRIPLES]
        out: list[tuple] = []
        if rows:
            bucket = rows[0]["bucket"]
            runs = [_from_planes(m["b"]) for m in rows]
            sizes = [len(r) for r in runs]
            names, place = _distinct(np.concatenate([_from_bytes(m["a"], 7) for m in rows]))
            history = np.repeat(place, np.concatenate(runs))
            lists, places = zip(*(_from_listed(m["c"]) for m in rows), strict=True)
            known, at = _distinct(np.concatenate(lists))
            ends = np.cumsum([len(x) for x in lists])[:-1]
            word = np.concatenate([of[p] for of, p in zip(np.split(at, ends), places, strict=True)])
            del lists, places, at
            count = np.concatenate([_from_planes(m["d"]) for m in rows])
            short = np.zeros(len(count), np.float32)
            short[count > 0] = np.concatenate([np.frombuffer(m["e"], np.float32) for m in rows])
            codes, group = _distinct(history * len(known) + word)
            total = np.bincount(group, count, len(codes)).astype(np.int64)
            lower = np.zeros(len(codes), np.float32)
            lower[group[count > 0]] = short[count > 0]  # the same from every block
            del word, count, short, history
            seen = np.flatnonzero(total)
            of = codes[seen] // len(known)
            by_class = _by_class(of, np.minimum(total[seen], K + 1), total[seen], len(names)).astype(np.int64)
            mass = np.bincount(of, np.round(lower[seen].astype(np.float64) * _UNIT), len(names))
            counts += counts_of_counts(total)
            rest = (1 - mass / _UNIT).astype(np.float32)
            frequent = (by_class[:, K + 1] > 0) & (by_class[:, : K + 1].sum(1) == 0)
            at, at_history = 0, 0
            for m, r, n in zip(rows, runs, sizes, strict=True):
                mine = place[at_history : at_history + n]
                k = int(r.sum())
                answer = total[group[at : at + k]]
                backs_off = mine[_backs_off(answer, np.append(0, np.cumsum(r)[:-1]))]
                out.append((FOUND, bucket, m["block"], _planes(answer), _planes(by_class[backs_off].T.ravel()), rest[backs_off].tobytes(), np.packbits(frequent[mine]).tobytes(), None))
                at, at_history = at + k, at_history + n
            if len(known_hot):
                p = np.flatnonzero(np.isin(names, known_hot))
                if len(p):
                    out.append((SPREAD, -1, -1, names[p].tobytes(), by_class[p].tobytes(), mass[p].astype(np.int64).tobytes(), None, None))
        out.append((TOTALS, -1, -1, None, None, None, counts.tobytes(), None))
        return pa.Table.from_batches([_rows(out)])

    return _grouped(tables)


def _explode_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for m in batch.to_pylist():
            names = np.frombuffer(m["a"], np.uint64).astype(np.int64)
            values = np.hstack([np.frombuffer(m["b"], np.int64).reshape(-1, K + 2), np.frombuffer(m["c"], np.int64)[:, None]])
            nth = np.tile(np.arange(K + 3, dtype=np.int32), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, K + 3)), pa.array(nth), pa.array(values.ravel())], ["name", "k", "n"])


def _score(buckets: int, hot: dict[int, int], spread: dict[int, list[int]], unigram: Unigram, d2: np.ndarray, d3: np.ndarray):
    def tables(rows: list[dict]) -> pa.Table:
        m = next(r for r in rows if r["pairs"] is not None)
        x = Known(m, unigram, d2)
        names = x.histories()
        order, cuts = x.deal_triples(x.asked, names, buckets, hot)
        n = len(x.second)
        count, kept, rest = x.triple_counts.copy(), np.zeros(n), np.ones(n)
        for r in rows:
            if r["pairs"] is None:
                k = r["bucket"]
                p = x.asked[order[cuts[k] : cuts[k + 1]]]
                count[p] = _from_planes(r["a"])
                starts = _starts(x.history[p])
                h = x.history[p[starts]]
                frequent = np.unpackbits(np.frombuffer(r["d"], np.uint8), count=len(h)).astype(bool)
                # Where nothing backs off, all that counts of what is kept is whether it is everything.
                kept[h] = np.where(frequent, x.pair_total[h], -1)
                h = h[_backs_off(count[p], starts)]
                kept[h] = _from_planes(r["b"]).reshape(K + 2, -1).T @ d3
                rest[h] = np.frombuffer(r["c"], np.float32)
        own = x.own()
        seen = own[count[own] > 0]
        at = x.history[seen]
        kept += _kept(at, np.minimum(count[seen], K + 1), count[seen], n, d3)
        short = x.p2_short.astype(np.float64)
        rest -= np.bincount(at, np.round(short[x.lower[seen]] * _UNIT), n) / _UNIT
        if spread:
            known = np.sort(np.fromiter(spread, np.uint64, len(spread)))
            found = np.isin(names >> np.uint64(8), known) & x.shared
            for h in np.flatnonzero(found).tolist():
                sums = spread[int(names[h] >> np.uint64(8))]
                kept[h], rest[h] = np.array(sums[:-1], float) @ d3, 1 - sums[-1] / _UNIT
        # A history's occurrences: those of its pair, as an end is no history.
        level = Level(x.pair_total, kept, rest, d3)
        p3 = level.p(count, x.history, short[x.lower])
        own_log = np.log10(x.p2)[x.pair]
        own_log[x.inner] = np.log10(p3)[x.triple]
        total = lambda values: np.add.reduceat(values, x.starts)
        ids = unpack(m["d"], np.int64).reshape(-1, 2)
        columns = [
            pa.array(ids[:, 0], pa.int64(), mask=ids[:, 1].astype(bool)),
            pa.array(unpack(m["e"], np.uint8).astype(bool)),
            pa.array(x.lengths),
            pa.array(total((x.word_counts > 0)[x.tokens].astype(np.int64))),
            pa.array(np.full(len(x.lengths), unigram.n, np.int64)),
            pa.array(total(np.log10(x.base)[x.tokens])),
            pa.array(total(own_log)),
        ]
        return pa.table(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return _grouped(tables)


def _frequent(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in bytes_of(batch.column("text")):
                found.update((text or b"").lower().split())
                found[END] += 1
        total = found.total()
        words = [w for w, c in found.items() if c >= share / 4 * total]
        rest = total - sum(found[w] for w in words)
        yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*(found[w] for w in words), rest], pa.int64())], ["word", "n"])

    return run


def hot_words(texts: DataFrame, n_texts: int, share: float) -> np.ndarray:
    """Hashes of words over a share of a sample's tokens: at most 1 / share."""
    part = min(1.0, SAMPLE / max(n_texts, 1))
    sample = texts.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    rows = arrow_map(sample.select("text"), _frequent(share), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    total = sum(r.n for r in rows)
    return np.sort(words_of([bytes(r.word) for r in rows if r.word is not None and r.n >= share * total]))


def score(documents: DataFrame) -> DataFrame:
    """What SCHEMA lists, for every document."""
    scratch = Scratch(documents.sparkSession, "katz")
    held = (crc32_mod(F.col("doc_id"), 5) == 1).alias("held_out")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held, F.col("text").cast("binary").alias("text"))
    blocks = scratch.keep(arrow_map(texts, _blocks, MESSAGE), "blocks")
    buckets = max(4, -(-blocks.count() * BLOCK_TOKENS // BUCKET_TOKENS))
    share = max(HOT / buckets, 1 / HOT_MOST)
    hot = hot_words(texts, texts.count(), share)
    # Hot words' counts, tokens and texts: sums taken from the blocks before the pairs meet.
    totals = np.zeros(len(hot) + 2, np.int64)
    for r in arrow_map(blocks, _totals(hot), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        totals[r.k] = r.n
    often = max(2, int(share * totals[-2]))
    requests = arrow_map(blocks, _ask_pairs(buckets, hot), MESSAGE)
    answers = scratch.keep(requests.groupBy("bucket").applyInArrow(_add_pairs(buckets, hot, totals[:-2], often), MESSAGE), "pairs", by="kind")
    stats = answers.filter(F.col("kind") == TOTALS).select("a", "b", "d").collect()
    stat = np.sum([np.frombuffer(r.d, np.int64) for r in stats], 0) if stats else np.zeros(K + 3, np.int64)
    d2 = discounts(stat[:-1])
    unigram = Unigram(int(totals[-2]), int(stat[-1] + (totals[:-2] > 0).sum()), int(totals[-1]))
    asked = arrow_map(blocks.select("block", "a"), _ask_histories(buckets), MESSAGE)
    masses = asked.unionByName(answers.filter(F.col("kind") == SUMS)).groupBy("bucket").applyInArrow(_add_histories(d2), MESSAGE)
    masses = scratch.keep(masses, "masses")
    scratch.drop(answers, part=f"kind={SUMS}")
    replies = answers.filter(F.col("kind") == COUNTS).unionByName(masses)
    # Blocks move with their texts, so a part of them at a time.
    meet = blocks.unionByName(replies).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(PARTS)))
    know = _know(buckets, hot, unigram, d2)
    parts = [scratch.keep(meet.filter(F.col("part") == k).drop("part").groupBy("block").applyInArrow(know, _KNOWN), "known") for k in range(PARTS)]
    known = reduce(DataFrame.unionByName, parts)
    scratch.drop(blocks, answers, masses)
    # Pairs that occur often, HOT_MOST at most, and over how many buckets each is spread.
    pairs = {int(n): int(c) for r in stats for n, c in zip(np.frombuffer(r.a, np.uint64), np.frombuffer(r.b, np.int64), strict=True)}
    pairs = {n: min(buckets, 1 + c // often) for n, c in pairs.items()}
    triples = arrow_map(known, _ask_triples(buckets, pairs, unigram, d2), MESSAGE)
    found = scratch.keep(triples.groupBy("bucket").applyInArrow(_add_triples(pairs), MESSAGE), "triples")
    stats = found.filter(F.col("kind") == TOTALS).select("d").collect()
    d3 = discounts(np.sum([np.frombuffer(r.d, np.int64) for r in stats], 0) if stats else np.zeros(K + 2, np.int64))
    spread: dict[int, list[int]] = {}
    sums = arrow_map(found.filter(F.col("kind") == SPREAD).select("a", "b", "c"), _explode_spread, "name long, k int, n long")
    for r in sums.groupBy("name", "k").agg(F.sum("n").alias("n")).collect():
        spread.setdefault(r.name, [0] * (K + 3))[r.k] = r.n
    empty = [F.lit(None).cast("binary").alias(c) for c in ("pairs", "words", "alphas", "totals")]
    own = known.select("block", F.lit(None).cast("long").alias("bucket"), "a", "b", "c", "d", "e", "pairs", "words", "alphas", "totals")
    replies = found.filter(F.col("kind") == FOUND).select("block", "bucket", "a", "b", "c", "d", "e", *empty)
    return own.unionByName(replies).groupBy("block").applyInArrow(_score(buckets, pairs, spread, unigram, d2, d3), SCHEMA)
