import collections
import math
import random
import zlib

import numpy as np
import pytest

from claimloom.llm import jaccard, katz, toxicity, wrappers
from claimloom.llm.common import Scratch, WordHashes, batch_hashes
from claimloom.llm.components import components

from .helpers import AWKWARD, LONG, documents, lower, words


def brute_components(rows, k, t):
    sets = {i: {tuple(ws[j : j + k]) for j in range(max(1, len(ws) - k + 1))} if (ws := words(lower(x))) else set() for i, x in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "t"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, k, t, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(k)
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(rng.choice([1, 3, 6, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5, 30 if g == 3 else 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(["xx", "yy", "zz"])
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t")]
    got = jaccard.join(documents(spark, rows, ["n_shingles", "component_id"]), k, t).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, t) and len(got) == len(rows)


def test_join_of_awkward_rows(spark):
    got = jaccard.join(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.join(documents(spark, [])).count() == 0
    kept = jaccard.keep_one(documents(spark, AWKWARD))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8, 9]


def test_one_row_of_a_group_stays_whatever_its_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(7, text), (7, text), (3, text + " end"), (7, other), (None, third), (None, third), (None, third + " end"), (9, None), (9, None), (None, "")]
    kept = jaccard.keep_one(documents(spark, rows, ["component_id"])).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept if r.doc_id is not None) == sorted([(3, text + " end"), (7, other), (9, ""), (9, "")])
    assert len([r for r in kept if r.doc_id is None and r.text]) == 1 and len(kept) == 6


def test_words_are_hashed_as_one_by_one():
    import pyarrow as pa

    texts = [t for _, t in AWKWARD] + [" a  B\tc\x0b\x0c", "\u00a0x\u2003y É", "\x1c\x1d a"]
    for column in (pa.array(texts, pa.string()), pa.array([t.encode() if t is not None else None for t in texts], pa.binary()), pa.array(["q"] + texts)[1:]):
        hashes, ends = batch_hashes(column)
        assert len(ends) == len(texts) + 1
        for t, lo, hi in zip(texts, ends, ends[1:], strict=False):
            assert hashes[lo:hi].tolist() == WordHashes().of([w.encode() for w in words(lower(t))]).tolist()
    assert [x.tolist() for x in batch_hashes(pa.array([], pa.string()))] == [[], [0]]


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = jaccard.bitmaps([a, b])
        assert (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2 >= len(np.intersect1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 199), (200, 199)]
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 199: 199, 200: 199}


def good_turing(counts):
    """Katz's discounts of counts 1 to 7, in plain Python, from the likeliest power law of the counts of counts 1 to 8."""
    n = collections.Counter(counts)
    n = {r: n[r] + 0.5 for r in range(1, 9)}

    def gain(b):
        whole = sum(r**b for r in n)
        return sum(n[r] * (math.log(r) - sum(q**b * math.log(q) for q in n) / whole) for r in n)

    low, high = -64, 64
    for _ in range(80):
        b = (low + high) / 2
        low, high = (b, high) if gain(b) > 0 else (low, b)
    smooth = {r: r**b for r in n}
    common = 8 * smooth[8] / smooth[1]
    out = {r: ((r + 1) * smooth[r + 1] / (r * smooth[r]) - common) / (1 - common) for r in range(1, 8)}
    return lambda r: out.get(r, 1.0)


@pytest.mark.parametrize("counts", [[0] * 9, [0, 5] + [0] * 7, [0] * 8 + [40], [9, 800, 90, 200, 3, 70, 0, 12, 11], [0, 10**12, 10**11, 10**10, 10**9, 10**8, 10**7, 10**6, 10**5]])
def test_discounts_rise_and_stay_inside(counts):
    d = katz.discounts(np.array(counts))
    assert d[0] == 0 and d[8] == 1 and (np.diff(d) > 0).all()
    # As good_turing() has them, which sees the n-grams themselves.
    if sum(counts) < 10_000:
        plain = good_turing([r for r, n in enumerate(counts) for _ in range(n)])
        assert d[1:8] == pytest.approx([plain(r) for r in range(1, 8)], rel=1e-9)


class BruteKatz:
    """The recursion from its definition, with dictionaries."""

    def __init__(self, texts):
        self.words = collections.Counter(w for t in texts for w in t)
        self.n = sum(self.words.values())
        padded = [["<s>", *t] for t in texts]
        self.seen = {k: collections.Counter(tuple(t[i - k + 1 : i + 1]) for t in padded for i in range(k - 1, len(t))) for k in (2, 3)}
        self.discount = {k: good_turing(self.seen[k].values()) for k in (2, 3)}
        self.after = collections.defaultdict(dict)
        for k in (2, 3):
            for gram, c in self.seen[k].items():
                self.after[gram[:-1]][gram[-1]] = c
        self.memo = {}

    def p(self, w, h=()):
        if not h:
            return (self.words[w] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))
        after = self.after.get(h)
        if not after:
            return self.p(w, h[1:])
        d = self.discount[len(h) + 1]
        total = sum(after.values())
        total += all(c > 7 for c in after.values())
        if w in after:
            return d(after[w]) * after[w] / total
        if h not in self.memo:
            self.memo[h] = (1 - sum(d(c) * c for c in after.values()) / total) / (1 - sum(self.p(x, h[1:]) for x in after))
        return self.memo[h] * self.p(w, h[1:])


def brute_katz(rows):
    docs = [[lower(w) for w in words(t)] + ["\n"] for _, t in rows]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 if i is not None else False for i, _ in rows]
    model = BruteKatz([d for d, h in zip(docs, held, strict=True) if not h])
    out = []
    for d, h in zip(docs, held, strict=True):
        padded = ["<s>", *d]
        full = sum(math.log10(model.p(padded[i], tuple(padded[max(0, i - 2) : i]))) for i in range(1, len(padded)))
        out.append((h, len(d), sum(model.words[w] > 0 for w in d), model.n, sum(math.log10(model.p(w)) for w in d), full))
    sums = [sum(model.p(w, h) for w in model.words) + model.p("unseen word", h) for h in list(model.after)[:40]]
    return out, sums


@pytest.mark.parametrize(("tokens", "most"), [(1_500_000, 20_000), (60, 20_000), (60, 12)])
def test_katz_equals_brute_force(spark, tokens, most, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 2 * tokens)
    monkeypatch.setattr(katz, "HOT_MOST", most)
    rng = random.Random(9)
    vocabulary = ["the"] * 30 + ["of"] * 9 + [f"w{i}" for i in range(40)]
    rows = [r for r in AWKWARD if r[0] != 6] + [(6, LONG[:3000])] + [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(150)]
    rows += [(1000 + i, "the same words again and again") for i in range(40)] + rows[20:40]
    want, sums = brute_katz(rows)
    assert sums == pytest.approx([1.0] * len(sums))
    got = katz.score(documents(spark, rows, ["score", "kind"]).coalesce(1)).collect()
    flat = lambda x: sorted((a, b, c, d, round(e, 6), f) for a, b, c, d, e, f in x)
    got, want = flat(tuple(r)[1:] for r in got), flat(want)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert sorted(x[5] for x in got) == pytest.approx(sorted(x[5] for x in want), abs=1e-4)


def test_grams_seen_once_are_discounted_and_not_backed_off(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    got = katz.score(documents(spark, [(i, f"a{i} b{i}") for i in ids])).collect()
    n = len(ids)
    # Pairs: (start, a), (a, b), (b, end), each once; triples: (start, a, b), (a, b, end), each once.
    d2, d3 = good_turing([1] * 3 * n)(1), good_turing([1] * 2 * n)(1)
    assert 0 < d3 < 1 and [r.score for r in got] == pytest.approx([math.log10(d2 / n * d3 * d3)] * n)


@pytest.mark.parametrize("tokens", [1_500_000, 40])
def test_words_whose_hashes_agree_in_32_bits_are_two_words(spark, tokens, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 4 * tokens)
    twins = katz.words_of([b"q252365", b"q127769"])
    assert twins[0] != twins[1] and twins[0] & np.uint64(2**32 - 1) == twins[1] & np.uint64(2**32 - 1)
    rng = random.Random(2)
    rows = [(i, f"see the {w} " + " ".join(f"w{rng.randrange(30)}" for _ in range(8))) for i, w in enumerate(["q252365", "q127769", "other"] * 40)]
    want, sums = brute_katz(rows)
    assert sums == pytest.approx([1.0] * len(sums))
    got = katz.score(documents(spark, rows).coalesce(1)).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx([x[5] for x in want], abs=1e-4)


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(31)
    vocabulary = ["the"] * 60 + ["of"] * 30 + [f"w{i}" for i in range(200)]
    ids = [i for i in range(1, 1500) if zlib.crc32(str(i).encode()) % 5 != 1]
    texts = [" ".join(rng.choices(vocabulary, k=60)) for _ in ids]
    rows = [(i, texts[k // 2] if k < 200 else texts[k]) for k, i in enumerate(ids)]
    score = {r.doc_id: r.score for r in katz.score(documents(spark, rows)).collect()}
    alone = {r.doc_id: r.score for r in katz.score(documents(spark, [(i, texts[k]) for k, i in enumerate(ids)])).collect()}
    # A text that the corpus has twice scores well above itself in a corpus that has it once.
    assert all(score[ids[2 * k]] - alone[ids[k]] > 10 for k in range(100))


def test_katz_of_no_texts(spark):
    assert katz.score(documents(spark, [])).count() == 0


def brute_segments(x):
    """Maximal segments by definition: recursively, the best one, then what lies beside it."""
    if not len(x):
        return []
    sums = np.concatenate([[0.0], np.cumsum(x)])
    best = max(((sums[j] - sums[i], -(j - i), i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=None)
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return [(a, b) for a, b in brute_segments(x[:i])] + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(x[j:])]


def test_segments_equal_their_definition():
    rng = random.Random(7)
    for _ in range(300):
        x = np.array([rng.choice([-0.3, -0.3, -0.31, 1.07, 2.003, 0.51]) + rng.random() * 1e-3 for _ in range(rng.randint(0, 25))])
        assert [(a, b) for a, b, _ in toxicity.segments_of(x)] == brute_segments(x)


def test_the_scan_is_linear():
    import time

    def took(n):
        began = time.perf_counter()
        found = toxicity.segments_of(np.array([1.0, -2.0] * n))
        assert len(found) == n
        return time.perf_counter() - began

    took(1000)
    assert took(64_000) < 40 * took(4_000) + 0.05


def test_every_segment_counts():
    model = toxicity.Model()
    p = [model.p_value([5.0] * r, 1000) for r in (8, 9, 12, 20)]
    assert p == sorted(p, reverse=True) and len(set(p)) == 4
    assert model.p_value([5.0] * 3000, 10_000_000) <= 1 and model.p_value([50.0] * 3000, 1000) == 1e-300


def test_scores_equal_brute_force(spark):
    rng = random.Random(41)
    clean, toxic = [f"n{chr(97 + i % 26)}{i}" for i in range(120)], ["vilest", "scummy", "rotten"]
    rows, labels = [], []
    for i in range(400):
        ws = rng.choices(clean, k=rng.randint(8, 30))
        if i % 5 == 0 or i % 37 == 1:
            ws[rng.randrange(len(ws))] = rng.choice(toxic) + rng.choice(["", "!", ","])
        rows.append((i, " ".join(ws).capitalize() + " " + "".join(rng.choices("abcdefgh", k=9))))
        labels.append((i, 1, int(i % 5 == 0)))
    df, marks = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    # The lexicon from its definition: Dirichlet log-odds and their standard error over the texts of folds 0 and 1.
    plain = lambda t: [w.strip(".,;:!?\"'()[]{}*#$%&|<>-_/\\") for w in t.lower().split()]
    features = lambda w, ending: {w, *(w[:k] + " " for k in (4, 5, 6) if len(w) > 4 and len(w) >= k + ending)}
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    sample = {r.doc_id for r in toxicity._labelled(df, marks).collect()}  # less what shares a sketch with an earlier one
    assert len(sample) > 290 and {fold(i) for i in sample} == {0, 1, 3}
    seen = [collections.Counter(), collections.Counter()]
    for i, t in rows:
        if fold(i) in (0, 1) and i in sample:
            seen[i % 5 == 0].update({f for w in set(plain(t)) for f in features(w, 2)})
    frequent = {f for f in seen[0] | seen[1] if seen[0][f] + seen[1][f] >= 4}
    n = [sum(s[f] for f in frequent) for s in seen]
    lexicon = {}
    for f in frequent:
        y = [s[f] + 5 * k / sum(n) for s, k in zip(seen, n, strict=True)]
        odds = math.log(y[1] / (n[1] + 5 - y[1])) - math.log(y[0] / (n[0] + 5 - y[0]))
        error = math.sqrt(1 / y[0] + 1 / y[1])
        if odds > 3.5 * error and odds - 1.64 * error >= 1:
            lexicon[f.encode()] = min(8.0, odds - 1.64 * error)
    assert model.lexicon == pytest.approx(lexicon) and len(lexicon) >= 3
    value = lambda w: max((lexicon[f.encode()] for f in features(w, 1) if f.encode() in lexicon), default=-0.3)
    held = [(i, [value(w) for w in plain(t)]) for i, t in rows if fold(i) == 3 and i in sample]
    good = [x for i, x in held if i % 5]
    assert model.share == pytest.approx((len(held) - len(good) + 1) / (len(held) + 10))
    # The scale solves the extreme-value equation over the words of clean texts held back, if it lies within its bounds.
    words_ = [round(v, 1) for x in good for v in x]
    assert max(words_) > 0
    if 0.3 < model.scale < 2:
        assert sum(math.exp(model.scale * v) for v in words_) / len(words_) == pytest.approx(1, abs=1e-6)
    tops = [model.scale * max((sum(x[a:b]) for a, b in brute_segments(np.array(x))), default=0.0) - math.log(max(len(x), 1)) for x in good]
    assert model.log_k == pytest.approx(sum(tops) / len(tops) - 0.5772, abs=1e-5)
    for r in toxicity.score(df, marks, model).collect():
        x = [value(w) for w in plain(rows[r.doc_id][1])]
        sums = sorted((sum(x[a:b]) for a, b in brute_segments(np.array(x))), reverse=True)
        best = 1.0 if sums else None
        for k in range(1, len(sums) + 1):
            t = sum(model.scale * v - model.log_k - math.log(len(x)) for v in sums[:k])
            if k > 1 and t <= k:
                break
            best = min(best, 1 - math.exp(-math.exp(-t)) if k == 1 else 2**k * math.exp(-t) * t ** (k - 1) / (math.factorial(k) * math.factorial(k - 1)))
        factor = -math.e * best * math.log(best) if best is not None and best < 1 / math.e else 1.0
        assert r.score == pytest.approx(model.share / (model.share + (1 - model.share) * factor), rel=1e-6)


def test_toxicity_is_learned_and_held_out(spark):
    rng = random.Random(11)
    clean = [f"n{i}" for i in range(600)]
    toxic = [f"vile{e}" for e in ("st", "ly", "ness", "ing", "ish", "ous")] + ["scummy"]
    rows, labels = [], []
    for i in range(900):
        ws = rng.choices(clean, k=rng.randint(15, 60))
        bad = i % 6 == 0
        if bad:
            for w in rng.choices(toxic, k=3):
                ws.insert(rng.randrange(len(ws)), w)
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(bad)))
    tale = " ".join(rng.choices(clean, k=30_000))
    df = documents(spark, rows + rows[:3] + [(5000, None), (5001, ""), (None, "vilest vilely vileness scummy vilest"), (6000, tale), (6001, tale + " vilest vilely vileness scummy vilest vileous")], ["score", "toxic"])
    marks = spark.createDataFrame(labels + [(3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, marks)
    got = toxicity.score(df, marks, model).collect()
    assert len(got) == 908 and {r.doc_id: r.predicted for r in got}[6000] < {r.doc_id: r.predicted for r in got}[6001] == 1
    assert all(len({r.score for r in got if r.doc_id == i}) == 1 for i in range(3))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    assert [r.predicted for r in got if r.doc_id in (5000, 5001)] == [0, 0] and [r.predicted for r in got if r.doc_id is None] == [1]
    assert any("vile" in p.passage for p in toxicity.passages(df, model).limit(5).collect())
    kept = toxicity.keep_clean(df, marks)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    nothing = marks.limit(0)
    assert {r.predicted for r in toxicity.score(df, nothing).collect()} == {0}
    assert toxicity.score(df.limit(0), marks).count() == 0


def page(n, article=True, extra=""):
    body = f"<h1>Title &amp; {n}</h1><p>First  {n}\n text<br>more <b>bold</b>word <p>Second{n} &lt;x&gt;&copy;{extra}"
    body = f"<article>{body}</article>" if article else f"<div class=story>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><header><a href=/>Site</a></header><nav><ul><li>A{n}<li>B</ul></nav><div class='ad'>Buy {n}<p>now</div>{body}<form><input>Send</form><aside>Side</aside><div id=comments><p>Reply {n}</div><footer>Foot</footer></body></html>"


WANT = "Title & {0}\nFirst {0} text more boldword\nSecond{0} <x>©"


def test_main_text(spark):
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(30)] + [(100 + i, f"http://c.d/{i}", page(i, False)) for i in range(9)]
    rows += [(205, "http://a.b/l", page(8, extra="<p>" + "long " * 100_000)), (200, None, None), (201, "x", ""), (202, "http://a.b/x", "plain &amp text"), (203, "http://a.b/y", page(7)[:-40]), (204, "http://a.b/z", "<div>" * 3000 + "deep" + "<p a='"), (0, "http://a.b/0", page(0))]
    got = wrappers.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == WANT.format(i) for i in range(30)) and all(by[100 + i] == WANT.format(i) for i in range(9))
    assert by[205] == WANT.format(8) + "\n" + ("long " * 100_000).strip() and by[200] == by[201] == "" and by[202] == "plain & text" and by[203] == WANT.format(7) and by[204] == "deep"
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrappers_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST", 0)
    got = wrappers.extract(spark.createDataFrame([(i, f"http://h{i % 3}/x", page(i)) for i in range(9)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: WANT.format(i) for i in range(9)}


def test_only_the_text_of_all_pages_is_the_templates(spark):
    text = lambda rows: {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    bare = lambda said, n: f"<div class=top>{said}</div><div class=story>Story {n}</div>"
    rows = [(i, f"http://t.a/{i}", bare("Site" if i % 20 else f"Only here {i}", i)) for i in range(400)]
    rows += [(1000 + i, f"http://c.a/{i}", f"<nav>{i}</nav>" + bare("Site", 7)) for i in range(40)]
    rows += [(2000 + i, f"http://v.a/{i}", bare("Sold" if i % 3 else f"Price {i}", i)) for i in range(300)]
    got = text(rows)
    assert all(got[i] == (f"Story {i}" if i % 20 else f"Only here {i}\nStory {i}") for i in range(400))
    assert all(got[1000 + i] == "Site\nStory 7" for i in range(40))
    assert all(got[2000 + i] == ("Sold" if i % 3 else f"Price {i}") + f"\nStory {i}" for i in range(300))
    assert text(rows[::-1]) == got


def extracted(spark, rows):
    return {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 99)) for _ in range(n)).capitalize() + "."


def site(rng, names, article, wrap, pages):
    """(html, main text) of pages of one template; names: classes of menu, advert, story, notice; all texts but the menu's vary."""
    menu, advert, story, notice = names
    out = []
    for _ in range(pages):
        parts = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 5))]
        title = prose(rng, 4)
        body = f"<h1>{title}</h1>" + "".join(f"<p>{x}</p>" for x in parts)
        body = f"<{article} class={story}>{body}</{article}>"
        links = "".join(f"<li><a href=/{k}>{prose(rng, 2)}</a>" for k in range(rng.randint(3, 6)))
        page = f"<div class={menu}><ul>{links}</ul></div><div class={advert}>{prose(rng, 7)}</div>{body}<div class={notice}>{prose(rng, 9)}</div>"
        out.append((f"<html><head><title>{title}</title></head><body>{'<div class=x><div>' * wrap}{page}{'</div></div>' * wrap}</body></html>", "\n".join([title, *parts])))
    return out


def test_roles_follow_from_the_texts_of_all_pages(spark):
    rng = random.Random(21)
    rows, want = [], {}
    hosts = [(("ka", "kb", "kc", "kd"), "div", 0), (("ka", "kb", "kc", "kd"), "section", 2), (("nav", "ad", "entry side", "footer"), "div", 1), (("a", "b", "sidebar", "d"), "div", 0), (("a", "b", "c", "d"), "article", 1)]
    for h, (names, article, wrap) in enumerate(hosts):
        for html, text in site(rng, [f"'{x}'" for x in names], article, wrap, 30):
            want[len(rows)] = text
            rows.append((len(rows), f"http://host{h}.a/{len(rows)}", html))
    assert extracted(spark, rows) == want
    # By names alone, without the host's wrapper, most of them are wrong.
    alone = [wrappers.content([(x, n, slot) for x, n, slot in zip(texts, linked, wrappers.slots(wrappers.Node(""), keys), strict=True)], {}) for keys, texts, linked in (wrappers.stream(html) for _, _, html in rows)]
    assert sum(a == want[i] for i, a in enumerate(alone)) <= 60
    body = [(i, "http://b.c/x", f"<html><body class='page sidebar'><h1>Head {i}</h1><p>{prose(rng, 30)} {i}</p></body></html>") for i in range(5)]
    assert all(t.startswith(f"Head {i}\n") for i, t in extracted(spark, body).items())


def test_markup_that_is_not_closed():
    text = lambda html: "|".join(wrappers.stream(html)[1])
    assert text("a <svg width='1'/> b <iframe/> c") == "a b c"
    assert text("<p>a<iframe src=x>b<p>c") == "ab|c" and text("<p>a<script>b<p>c") == "a"
    assert text("<datalist><option>x<option>y</datalist><p>z") == "x|y|z" and text("x<select><option>a<option>b</select>y") == "xy"
    assert text("buy <span class='ad'>now or never") == "buy" and text("a&am<b>p;b</b> &amp;amp;") == "a&amp;b &amp;"
    keys, texts, linked = wrappers.stream("<ul><li><a href=x>One</a><li>Two <a>three</a></ul>")
    assert texts == ["One", "Two three"] and linked == [3, 5]


def test_long_rows_of_siblings(spark):
    import time

    began = time.time()
    html = [f"<html><body><article><h1>T</h1>{''.join(f'<p class=c{chr(97 + (k * step) % 23)}{chr(97 + k % 19)}>t{k}</p>' for k in range(4000))}</article></body></html>" for step in (1, 7)]
    got = extracted(spark, [(i, "http://l.o/x", h) for i, h in enumerate(html)])
    assert all(got[i].split("\n") == ["T", *(f"t{k}" for k in range(4000))] for i in (0, 1)) and time.time() - began < 60
    assert wrappers._matches(list("abcbdab"), list("bdcaba")) and len(wrappers._matches(list("abcbdab"), list("bdcaba"))) == 4


def test_folding_and_aligning():
    a = wrappers.infer([page(1), page(2, extra="<ul><li>x</ul>"), page(3)])
    found = {}

    def walk(node, path):
        for k in node.kids:
            found["/".join([*path, k.key])] = k
            walk(k, [*path, k.key])

    walk(a, [])
    li = next(v for k, v in found.items() if k.endswith("<nav/<ul/<li"))
    assert li.repeated and next(v for k, v in found.items() if k.endswith("<article/<ul")).optional
