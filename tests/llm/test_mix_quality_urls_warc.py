import math
import random

import numpy as np
import pytest

from claimloom.llm import mixing, quality, urls, warc
from claimloom.llm.common import WordHashes

from .helpers import AWKWARD, LONG, documents, words


def test_seats_equal_the_highest_quotients():
    rng = random.Random(3)
    for _ in range(500):
        shares = [rng.choice([0, 1, 2, 5.5, rng.random() * 1000]) for _ in range(rng.randint(1, 7))]
        seats = rng.randint(0, 200)
        order = sorted((-s / (2 * k + 1), i) for i, s in enumerate(shares) if s > 0 for k in range(seats + 1))[:seats]
        assert mixing.sainte_lague(seats, shares) == [sum(i == j for _, i in order) for j in range(len(shares))]


def test_targets_stop_and_share_the_excess():
    assert mixing.targets([10, 1000, 1000, 0], [5, 2, 1, 5]) == [30.0, 1320.0, 660.0, 0.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1, "x y z", "b"), (1, "x y z", "b"), (None, "q", None)]
    df = documents(spark, rows, ["size", "target"])
    got = mixing.plan_mix(df, shard=4000).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(len(words(t)) for _, t, _ in rows)
    for source in ("a", "b", "c", None):
        part = [r for r in got if r.source == source]
        assert all(r.source_size == sum(len(words(t)) for _, t, s in rows if s == source) for r in part)
        assert abs(sum(r.taken for r in part) - part[0].target) <= mixing.BLOCK * 12
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(total)
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.plan_mix(df.repartition(7), shard=4000).collect())
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert mixing.mix_digest(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_digest(documents(spark, [(1, None), (2, "")])).collect()} == {0}


def test_the_mix_is_applied_as_planned(spark, monkeypatch):
    import collections

    rng = random.Random(15)
    monkeypatch.setattr(mixing, "SHARDS", 6)
    for shard in (300, 10**6):
        rows = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 40))), rng.choice(["a", "a", "b", None])) for i in range(120)] + [(7, "same text here", "a")] * 40 + [(None, "x " * 30, None)] * 20 + [(8, LONG, "b"), (9, None, "a")]
        rng.shuffle(rows)
        docs = documents(spark, rows, ["row", "times", "place", "__id"])
        plan = mixing.plan_mix(docs, shard=shard).collect()
        want = collections.Counter()
        for r in plan:
            want[r.doc_id, r.source, r.size] += r.epochs + (r.rest > 0 and 2 * r.rest >= r.size)
        out = mixing.apply_mix(docs, shard=shard)
        got = collections.Counter((r.doc_id, r.source, len(words(r.text))) for r in out.collect())
        assert out.columns == docs.columns and got == +want and {r.row for r in out.select("row").collect()} == {"clash"}


def brute(text):
    ws = words(text)
    lines = (text or "").split("\n")
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    cover = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            cover.update(range(i, i + 8))
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def test_rows_of_one_id_and_size_are_taken_as_planned(spark):
    rows = [(None, f"n{i} " * 40, "a") for i in range(80)] + [(5, f"r{i} " * 40, "a") for i in range(3)] + [(100 + i, f"w{i} " * 30, "b") for i in range(100)]
    docs = documents(spark, rows, ["size"])
    plan = mixing.plan_mix(docs).collect()
    want = sorted((r.doc_id or -1, r.size) for r in plan for _ in range(r.epochs + (r.rest > 0 and 2 * r.rest >= r.size)))
    times = {r.epochs + (r.rest > 0 and 2 * r.rest >= r.size) for r in plan if r.doc_id is None}
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns and len(times) == 2
    assert sorted((r.doc_id or -1, len(r.text.split())) for r in got.collect()) == want


def test_quality_counts(spark):
    texts = [" ".join("abcdefghij") * 3, "x y\nx y\n\n\nz\nx y", "# $ a|b <c> 100%", ("lorem ipsum dolor sit amet consectetur adipiscing elit " * 4).strip(), "Ünï\u00a0code\x0bw"]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(texts)]
    got = quality.judge(documents(spark, rows, ["kept", "n_words", "pattern"])).collect()
    assert len(got) == len(rows)
    for r in got:
        for t in {t for i, t in rows if i == r.doc_id}:
            want = (60000, len(LONG.replace(" ", "")), 0, 0, 0) if t == LONG else brute(t)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.kept or not r.base_failed)
    assert quality.judge(documents(spark, [])).count() == 0


def test_rules_are_weighed(spark):
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(400)]
    good = [(i, ". ".join(" ".join(rng.choices(vocabulary, k=12)).capitalize() for _ in range(8))) for i in range(150)]
    bad = [(1000 + i, " ".join(w.upper() + "!! ###" for w in rng.choices(vocabulary, k=60))) for i in range(30)]
    df = documents(spark, good + bad)
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {i for i, _ in good} and quality.keep_good(df).columns == df.columns
    assert kept == {r.doc_id for r in quality.judge(df).collect() if r.kept}


def brute_kept(votes):
    """Expectation-maximisation document by document; votes: of each document, 0, 1 (bad) or 2 (good) of each rule."""
    rules = len(votes[0])
    ends = []
    for share in (0.5, 0.8, 0.95):
        bad_of, good_of = ([[quality.PRIOR[c][r][v] for v in range(3)] for r in range(rules)] for c in (0, 1))
        for _ in range(400):
            posterior, whole = [], 0.0
            for row in votes:
                good = share * math.prod(good_of[r][v] for r, v in enumerate(row))
                bad = (1 - share) * math.prod(bad_of[r][v] for r, v in enumerate(row))
                posterior.append(good / (good + bad))
                whole += math.log(good + bad)
            prior = sum(10 * quality.PRIOR[c][r][v] * math.log(max(t[r][v], 1e-300)) for c, t in ((0, bad_of), (1, good_of)) for r in range(rules) for v in range(3))
            end = whole + prior + 2 * math.log(1 - share) + 8 * math.log(share), posterior
            n = [len(votes) - sum(posterior), sum(posterior)]
            for r in range(rules):
                count = [[sum(1 - p for p, row in zip(posterior, votes) if row[r] == v) for v in range(3)], [sum(p for p, row in zip(posterior, votes) if row[r] == v) for v in range(3)]]
                new = [[(count[c][v] + 10 * quality.PRIOR[c][r][v]) / (n[c] + 10) for v in range(3)] for c in (0, 1)]
                if new[1][1] > 0.005:
                    new[1] = [0.995, 0.005, 0.0]
                if new[0][1] < new[1][1] or new[0][2] > new[1][2]:
                    new = [[(count[0][v] + count[1][v] + 5 * (quality.PRIOR[0][r][v] + quality.PRIOR[1][r][v])) / (len(votes) + 10) for v in range(3)]] * 2
                bad_of[r], good_of[r] = new
            share = (n[1] + 8) / (len(votes) + 10)
        ends.append(end)
    return max(ends, key=lambda e: e[0])[1]


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(300)]
    kinds = [lambda ws: " ".join(ws), lambda ws: " ".join(w + "###" for w in ws), lambda ws: " ".join(w.upper() + "!!" for w in ws), lambda ws: " ".join(w for w in ws[:8] for _ in range(9)), lambda ws: " | ".join(ws), lambda ws: " ".join(ws[:30])]
    texts = [rng.choice(kinds[:1] * 9 + kinds)(rng.choices(vocabulary, k=rng.randint(30, 90))) for _ in range(250)]
    rows = list(enumerate([*texts, *texts[:5], None, "", "few words"]))
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows)).collect()}
    facts = [quality.Facts((t or "").encode(), WordHashes()) for _, t in rows]
    votes = [quality.votes_of(np.array([quality.pattern_of(f)]))[0].tolist() for f in facts]
    want = brute_kept(votes)
    assert [got[i].quality for i, _ in rows] == pytest.approx(want, abs=1e-4)
    assert all(got[i].kept == (not got[i].base_failed and got[i].quality >= 0.5) for i, _ in rows)
    assert sum(not r.kept and not r.base_failed for r in got.values()) > 20
    clean = {i for i, t in enumerate(texts) if set(t) <= set("word0123456789 ") and t.split()[0] != t.split()[1]}
    assert all(got[i].kept for i in clean)


def test_repeated_words_of_any_sequence():
    rng = random.Random(2)
    hashes = WordHashes()
    for _ in range(100):
        ws = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        assert quality.repeated_words(hashes.of([w.encode() for w in ws])) == brute(" ".join(ws))[4]
    assert quality.repeated_words(np.zeros(0, np.uint64)) == 0


def test_hosts_paths_and_curated_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "https://example.net/de", "example.net", "/de", "net/", "block"), (3, "http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
        (4, "http://notnet/en/", "notnet", "/en/", None, "allow"), (5, "http://net", "net", "", None, "allow"), (6, "net/", "", "", None, "allow"), (7, None, "", "", None, "allow"), (8, "http://h.com#f/x", "h.com", "", None, "allow"),
        (8, "http://h.com#f/x", "h.com", "", None, "allow"), (9, "x://m.example.com/de/é?q=1", "m.example.com", "/de/é", "example.com/de/", "block"), (None, "http://" + "a." * 3000 + "net/" + "p/" * 3000, None, None, "net/", "block"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge(pages, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        want = next(x for x in rows if x[0] == r.page_id)
        assert (r.rule, r.verdict) == want[4:] and (want[2] is None or (r.host, r.path) == want[2:4])


def test_mined_rules_block(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{'www.' if i % 2 else ''}{'spam-shop' if i % 5 == 0 else 'site' + str(i % 7)}.example.com/{rng.choice(['en', 'fr'])}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined) for r in urls.judge(pages, labels).collect()}
    assert all(got[i] == (("block", "h:spam-shop") if i % 5 == 0 else ("allow", None)) for i in range(400))


def test_rules_are_pruned_before_any_bound(spark, monkeypatch):
    rows = [(i, f"http://{'bad' + str(i % 4) if i % 2 else 'good' + str(i % 6)}.shop/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + rows[:9] + [(None, "http://bad1.shop/"), (None, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    want = sorted((i if i is not None else -1, "block" if "bad" in (u or "") else "allow", f"h:bad{i % 4}" if "bad" in (u or "") and i is not None else None) for i, u in [*rows, *rows[:9]])
    for bound in (1000, 2, 1):
        monkeypatch.setattr(urls, "MAX_RULES", bound)
        got = urls.judge(pages, labels).collect()
        assert sorted((r.page_id, r.verdict, r.mined) for r in got if r.page_id is not None) == want
        assert sorted((r.verdict, r.mined or "") for r in got if r.page_id is None) == [("allow", ""), ("block", "h:bad1")]


def test_all_tokens_are_mined(spark):
    import collections
    import itertools

    rng = random.Random(8)
    deep = "/".join(f"d{chr(97 + k)}" for k in range(14))
    rows = [(i, f"http://www.h.org/{deep}?{rng.choice('xyz')}{rng.choice('uvw')}={i}&{rng.choice('pq')}=1") for i in range(600)]
    bad = {i: ("xu" in u and rng.random() < 0.9) or "yv" in u and "&p=" in u for i, u in rows}
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - bad[i], 0) for i in range(500)], "doc_id long, quality int, toxic int")
    sets = {i: {"q:" + u.split("?")[1].split("=")[0], "q:" + u.split("&")[1][0]} for i, u in rows}
    every = lambda i: [c for k in (1, 2) for c in itertools.combinations(sorted(sets[i]), k)]
    c, cb = (collections.Counter(s for i in range(500) if bad[i] or not only for s in every(i)) for only in (False, True))
    rules = {s for s in cb if cb[s] >= 20 and cb[s] / c[s] >= 0.6 and cb[s] / c[s] / (sum(bad[i] for i in range(500)) / 500) >= 1.5}
    want = {i: "block" if rules & set(every(i)) else "allow" for i, _ in rows}
    assert len(set(want.values())) == 2
    assert {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()} == want


def test_rules_are_the_same_either_way(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        tokens = sorted(rng.sample("abcdefgh", rng.randint(0, 6)))
        rows.append((tokens, {"a", "c", "e"} <= set(tokens) or {"b", "g"} <= set(tokens) and rng.random() < 0.8 or rng.random() < 0.05))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    found = []
    for bound in (0, 12):
        monkeypatch.setattr(urls, "MAX_TOKENS", bound)
        found.append(sorted((tuple(r.tokens), round(r.confidence, 9), r["count"]) for r in urls.mine(labelled).collect()))
    assert found[0] == found[1] and {len(t) for t, _, _ in found[0]} >= {2, 3}


def test_records_round_trip():
    import zlib

    def member(b):
        c = zlib.compressobj(9, zlib.DEFLATED, 31)
        return c.compress(b) + c.flush()

    one = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one + one, member(one) + member(one)):
        found = warc.read_records(data)
        assert [(f["warc-type"], b) for _, f, b in found] == [("resource", b"abc")] * 2 and found[1][0] == len(data) // 2
    with pytest.raises(ValueError):
        warc.parse_record(one[:-3])


def test_fixity(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i} é</p>" * 50) for i in range(-3, 500)] + [(3, "http://h/3", "other"), (3, "http://h/3", "other"), (None, None, None), (None, "x", LONG), (10**12, "u", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, volume string")
    archive = warc.lay_out(warc.to_records(pages))
    assert {r.status for r in warc.audit(archive, archive.repartition(3)).collect()} == {"intact"}
    stored = archive.collect()
    assert len(stored) == len(rows)
    # Every volume is a WARC file: its records follow one another and are read back where they were put.
    for volume in {r.volume for r in stored}:
        part = sorted((r for r in stored if r.volume == volume), key=lambda r: r.offset)
        found = warc.read_records(b"".join(r.record.encode() for r in part))
        assert [at for at, _, _ in found] == [r.offset for r in part]
        assert all(f["warc-target-uri"] in (f"http://h/{r.page_id}", "u") for (_, f, _), r in zip(found, part, strict=True) if r.page_id is not None)
    assert len({r.volume for r in stored if r.page_id is None} & {r.volume for r in stored if r.page_id is not None}) == 0
    rng = random.Random(6)
    for damage in (0, 1, 5, 60):
        kept, want = [], {}
        for r in stored:
            said = rng.choice(["changed", "missing", "moved", "copies", "shortened"]) if rng.random() < damage / len(stored) else "intact"
            if sum((x.volume, x.record) == (r.volume, r.record) for x in stored) > 1:
                said = "intact"
            want[r.volume, r.offset] = {"shortened": "changed"}.get(said, said)
            row = (r.volume, r.offset + (said == "moved"), r.page_id, {"changed": r.record[:50] + "~" + r.record[51:], "shortened": r.record[:-9]}.get(said, r.record))
            kept += [] if said == "missing" else [row, row] if said == "copies" else [row]
        kept.append(("0-0", 10**7, 7, "new"))
        rng.shuffle(kept)
        got = warc.audit(archive, spark.createDataFrame(kept, archive.schema)).collect()
        assert {(r.volume, r.offset): r.status for r in got} == {**want, ("0-0", 10**7): "extra"} and len(got) == len(rows) + 1
    none = archive.limit(0)
    assert warc.audit(none, none).count() == 0
    assert {r.status for r in warc.audit(archive, none).collect()} == {"missing"}


def test_a_crowded_id_is_dealt_over_volumes(spark, monkeypatch):
    monkeypatch.setattr(warc, "PER_VOLUME", 4)
    pages = spark.createDataFrame([(1, "u", f"<p>{i}") for i in range(300)] + [(100, "u", "x")], "page_id long, url string, html string")
    volumes = warc.lay_out(warc.to_records(pages)).groupBy("volume").count().collect()
    assert len(volumes) > 10 and max(r["count"] for r in volumes) < 60
