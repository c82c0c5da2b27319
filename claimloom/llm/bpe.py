"""Byte-pair encoding and decoding with a published vocabulary (tokenizers JSON, word-end suffix).

All new words of a batch are laid out in one symbol array. A pair occurrence index maps each
mergeable pair, by its rank, to all its positions in that array; a heap yields the active ranks in
ascending order; each merge rewrites all of its positions at once and files the pairs it has made
under their own ranks. Words are independent and a merge can only make pairs of higher rank
(checked when a model is loaded), so this equals merging word by word.

Defined cases: null and empty texts have no tokens; special tokens written in a text become their
own ids, as in the library; very long texts are encoded whole, as many words at a time as fit; an
empty table gives an empty result; repeated rows repeat; extra input columns are ignored by the
digest, kept by encode and decode.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import arrow_map, bytes_of

DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _check(spec: dict) -> None:
    """ValueError unless the definition asks for what is done here: NFC, blanks for white space, lower case; words cut out, as bytes; no decoder."""
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    split = spec["pre_tokenizer"]["pretokenizers"][0] if cuts else {}
    plain = not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and bool(spec["model"].get("end_of_word_suffix"))
    added = all(not x["normalized"] and not x["single_word"] and not x["lstrip"] and not x["rstrip"] for x in spec["added_tokens"])
    if steps != ["NFC", "Replace", "Lowercase"] or cuts != ["Split", "ByteLevel"] or (split.get("behavior"), split.get("invert")) != ("Removed", True) or spec["decoder"] or not plain or not added:
        raise ValueError("the tokenizer's definition has steps that are not supported here")


class BpeModel:
    """Encodes texts to ids and ids to text. Words once encoded are remembered, within a bound."""

    REMEMBERED = 300_000

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        model = spec["model"]
        _check(spec)
        self.end = model["end_of_word_suffix"]
        self.vocab = {k: v for k, v in model["vocab"].items()} | {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for k, v in self.vocab.items():
            self.tokens[v] = k
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split).findall
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        letters = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([self.vocab["".join(m)] for m in merges], np.int64)
        self.size = len(self.tokens)
        born = np.full(self.size, -1, np.int64)
        for r in range(len(merges) - 1, -1, -1):
            born[made[r]] = r
        rank = np.arange(len(merges))
        if not ((born[left] < rank) & (born[right] < rank) & (born[made] == rank)).all():
            raise ValueError("a merge comes before the one that makes its part; ranks cannot be applied in ascending order")
        code = left * self.size + right
        self.order = np.argsort(code)
        self.codes = code[self.order]
        self.left, self.right, self.made = left, right, made
        self.known: dict[str, bytes] = {}
        self.shown: dict[bytes, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (non-empty) word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        symbol = self.inner[data]
        symbol[ends - 1] = self.last[data[ends - 1]]
        # Position n stands for "no neighbour"; its symbol -1 pairs with nothing.
        symbol = np.append(symbol, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[ends - lengths] = n, n
        after[n] = n
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            """Put each position under the rank of the pair that begins there."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            keep = (rank >= 0) & (after[at] < n)
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r not in index:
                    heapq.heappush(active, r)
                index[r].append(positions)

        file(np.arange(n))
        while active:
            r = heapq.heappop(active)
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            a, b = self.left[r], self.right[r]
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # of an odd run such as aaa, the left pair goes first
                taken, keep = -1, []
                for p in at.tolist():
                    if p != taken:
                        keep.append(p)
                        taken = int(after[p])
                at = np.array(keep, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbol[at] = self.made[r]
            symbol[gone] = -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at  # what lands in before[n] is never read
            file(at)
            earlier = before[at]
            file(earlier[earlier < n])
        alive = np.flatnonzero(symbol[:n] >= 0)
        return np.split(symbol[alive], np.searchsorted(alive, ends[:-1]))

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > self.REMEMBERED:
            self.known.clear()
            self.shown.clear()
            fresh = list(words)
        for lo in range(0, len(fresh), 100_000):
            part = fresh[lo : lo + 100_000]
            for w, ids in zip(part, self.merge([w.encode() for w in part]), strict=True):
                self.known[w] = ids.astype("<u4").tobytes()

    def split(self, text: str) -> list[list[str] | int]:
        """Lists of words, and ids of special tokens between them."""
        if self.special is None or "<|" not in text:
            return [self._words(text)]
        return [self.vocab[x] if i % 2 else self._words(x) for i, x in enumerate(self.special.split(text))]

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased by itself, also at a word's end
        return self.words(text.lower())

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        part: list[list] = []
        new: set[str] = set()
        size = 0
        for text in texts:
            parts = self.split(text or "")
            part.append(parts)
            for x in parts:
                if isinstance(x, list):
                    new.update(x)
                    size += len(x)
            if size > 500_000:  # words held at a time
                out += self._encoded(part, new)
                part, new, size = [], set(), 0
        return out + self._encoded(part, new)

    def _encoded(self, texts: list[list], words: set[str]) -> list[bytes]:
        self.learn(words)
        known = self.known.__getitem__
        return [b"".join(b"".join(map(known, x)) if isinstance(x, list) else x.to_bytes(4, "little") for x in parts) for parts in texts]

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between any two, as the library does for a model without a decoder."""
        return " ".join([self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_models: dict[int, BpeModel] = {}


def _model(shipped) -> BpeModel:
    """One model per worker process and definition."""
    key = hash(shipped.value)
    if key not in _models:
        _models[key] = BpeModel(shipped.value)
    return _models[key]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [(x or b"").decode("utf-8", "replace") for x in bytes_of(batch.column("text"))]


def ship(spark: SparkSession, path: str):
    """The definition file (a few MB), broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, path: str) -> DataFrame:
    """The input with a column ids: array of int (added, or replaced if there is one)."""
    shipped = ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in _model(shipped).encode_batch(_texts(batch))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(ids, pa.list_(pa.int32()))], [*keep, "ids"])

    keep = [c for c in documents.columns if c != "ids"]
    schema = documents.select(*(F.col(f"`{c}`") for c in keep)).schema.add("ids", ArrayType(IntegerType()))
    return arrow_map(documents.select(*(F.col(f"`{c}`") for c in keep)), run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The input with a column decoded: the text of its ids."""
    shipped = ship(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_model(shipped).decode(np.asarray(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(texts, pa.string())], [*keep, "decoded"])

    keep = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*(F.col(f"`{c}`") for c in keep)).schema.add("decoded", StringType())
    return arrow_map(encoded.select(*(F.col(f"`{c}`") for c in keep)), run, schema)


def token_digest(documents: DataFrame, path: str) -> DataFrame:
    """Encode and decode each whole text; what DIGEST_SCHEMA lists."""
    shipped = ship(documents.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = _model(shipped)
            ids = model.encode_batch(_texts(batch))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(sha, ids), pa.string()),
                    pa.array((sha(model.decode(x).encode()) for x in ids), pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), run, DIGEST_SCHEMA)
