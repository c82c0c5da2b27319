"""Which sets the Jaccard join draws together before their texts move."""

from __future__ import annotations

import numpy as np
import pytest

from claimloom.llm import jaccard


def test_a_frequent_shingle_draws_only_sets_together_that_can_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = np.random.default_rng(3)
    drawn = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    common, base = drawn(1), drawn(200)
    sets = [np.unique(np.concatenate([common, drawn(100 + k)])) for k in range(60)]  # alike in one shingle
    sets += [np.unique(np.concatenate([common, base[: 200 - k % 7], drawn(k % 5)])) for k in range(40)]  # near copies
    rows = [(k, len(s), [int(common[0])], jaccard.parity(s)) for k, s in enumerate(sets)]
    firsts = spark.createDataFrame(rows, "nid long, n long, prefix array<long>, parity binary")
    documents = spark.createDataFrame([], "doc_id long, text string")
    assert {(r.nid, r.cluster) for r in jaccard.Join(documents).clusters(firsts).collect()} == {(k, 60) for k in range(60, 100)}


@pytest.mark.parametrize("threshold", [50, 80, 85])
def test_near_parities_miss_no_link(threshold):
    rng = np.random.default_rng(threshold)
    sets = []
    for n in (1, 2, 3, 5, 40, 64, 65, 130, 700):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for k in range(6):
            sets.append(np.unique(np.concatenate([base[: max(1, n - k * n // 40)], rng.integers(0, 1 << 63, k * n // 20, dtype=np.uint64)])))
    sets.sort(key=len)
    near = lambda i, j: jaccard.near_in([i, j], [(len(sets[k]), jaccard.parity(sets[k])) for k in (i, j)], [True, True], threshold)
    linked = 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                linked += 1
                assert near(i, j) == [(i, j)]
    assert linked > 30
