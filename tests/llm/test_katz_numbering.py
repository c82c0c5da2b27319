"""How op9's blocks number their words, pairs and triples."""

import types

import numpy as np
import pyarrow as pa
import pytest

from claimloom.llm import katz

from .helpers import AWKWARD, lower, words


def same(x):
    got, want = katz._distinct(x), np.unique(x, return_inverse=True)
    assert got[0].dtype == x.dtype and (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_values_are_numbered_as_unique_does():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 70_000):
        for kind, bits in ((np.int64, 1), (np.int64, 34), (np.int64, 62), (np.uint64, 56), (np.uint64, 64)):
            x = rng.integers(0, 1 << bits, n, kind) if n else np.zeros(0, kind)
            same(x)
            same(rng.choice(x, n) if n else x)
    # Places of 13 bits leave out the lowest 5 of 56: these differ in them only, and come in no order.
    x = np.uint64(1 << 55) + rng.integers(0, 1 << 7, 5000).astype(np.uint64)
    same(x)
    same(np.array([2**63 + 3, 2**63 + 1, 2**63 + 3, 7], np.uint64))


def test_integers_take_the_bytes_that_the_largest_needs():
    for width in range(1, 9):
        x = np.array([0, 1, 255, 2 ** (8 * width - 1) - 1, 3] * 50)
        packed = katz._planes(x)
        assert packed[0] == width and katz._from_planes(packed).tolist() == x.tolist()
    assert katz._from_planes(katz._planes(np.zeros(0, np.int64))).tolist() == []
    assert katz._from_planes(katz._planes(np.array([2**62, 5]))).tolist() == [2**62, 5]


def blocks_of(texts, size, monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    column = lambda x: pa.array([t.encode() if t is not None else None for t in x], pa.binary())
    ids = list(range(len(texts)))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(ids[i : i + size], pa.int64()), pa.array([k % 5 == 1 for k in ids[i : i + size]]), column(texts[i : i + size])], ["doc_id", "held_out", "text"])
        for i in range(0, len(ids), size)
    ]
    return [m for b in katz._blocks(iter(batches)) for m in b.to_pylist()]


TEXTS = [t for _, t in AWKWARD if t is None or len(t) < 1000] + [f"The w{i % 7} of w{i % 5} x{i}" for i in range(60)]


@pytest.mark.parametrize(("tokens", "size"), [(10**6, 1000), (10**6, 7), (40, 1000), (40, 7), (1, 3)])
def test_blocks_hold_their_own_words_only(tokens, size, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    at = 0
    for m in blocks_of(TEXTS, size, monkeypatch):
        x = katz.Block(m)
        got = [x.words[x.tokens[s : s + n]].tolist() for s, n in zip(x.starts, x.lengths, strict=True)]
        want = [[*katz.words_of([lower(w).encode() for w in words(t)]).tolist(), int(katz.words_of([katz.END])[0])] for t in TEXTS[at : at + len(got)]]
        assert got == want and sorted(x.words.tolist()) == sorted({w for t in want for w in t})
        at += len(got)
    assert at == len(TEXTS)


def test_pairs_and_triples_are_numbered_by_plain_sorts(monkeypatch):
    (m,) = blocks_of(TEXTS, 1000, monkeypatch)

    def refused(*args, **kwargs):
        raise AssertionError("sorts by way of places, at twice the time")

    monkeypatch.setattr(np, "unique", refused)
    x = katz.Block(m)
    x.triples()
    monkeypatch.undo()
    names = x.names.tolist()
    start = names[-1]
    texts = [[start, *x.words[x.tokens[s : s + n]].tolist()] for s, n in zip(x.starts, x.lengths, strict=True)]
    pairs = [p for t in texts for p in zip(t, t[1:], strict=False)]
    assert [(names[x.first[p]], names[x.second[p]]) for p in x.pair] == pairs and len(x.second) == len(set(pairs))
    triples = [p for t in texts for p in zip(t, t[1:], t[2:], strict=False)]
    got = [(names[x.first[h]], names[x.second[h]], names[w]) for h, w in zip(x.history[x.triple], x.word[x.triple], strict=True)]
    assert got == triples and len(x.word) == len(set(triples))
    assert [(names[x.first[p]], names[x.second[p]]) for p in x.lower[x.triple]] == [t[1:] for t in triples]
