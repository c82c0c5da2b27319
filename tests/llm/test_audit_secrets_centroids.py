import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm import centroids, filter_audit, secret_scan

from .helpers import AWKWARD, LONG, documents, words

# --- filter interaction audit ---


def failed_filters(rows):
    """Per row, the letters of the filters that fail it, by their definition."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = words(text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        checks = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
        out.append({f for f, failed in zip("ABCDE", checks, strict=True) if failed})
    return out


def audited(rows, labels):
    """The whole result, order by order."""
    failed, out = failed_filters(rows), {}
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    for part in {s or "" for _, _, s in rows}:
        mine = [(i, f) for (i, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        taken = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i, fs in left if f in fs]
                left = [(i, fs) for i, fs in left if f not in fs]
                taken[f] += len(gone)
                redundant = sum(f in fs for _, fs in mine) - len(gone)
                alone = sum(fs == {f} for _, fs in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, alone, sum(i in good for i in gone), sum(i in toxic for i in gone), f]
        for (p, *_), row in out.items():
            if p == part:
                row[-1] = taken[row[-1]]
    return out


def audit_of(spark, rows, labels, extra=(), **options):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(documents(spark, rows, extra), marks, **options).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(found) == len(got)
    return found


def test_the_audit_equals_all_orders_by_brute_force(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["aa", "b", "Cc", "DDDD", "x#", "e f"]) for _ in range(rng.randint(0, 90))) for _ in range(12)] + [" ".join(f"w{i}" for i in range(60)), LONG, "", None]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["a", "a", "a", "b", "", None])) for _ in range(160)]
    rows += [(7, texts[0], "a")] * 30 + [(3, texts[0], "b")] + [(None, texts[1], None)] * 30 + [(*r, "s") for r in AWKWARD]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(45)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    want = audited(rows, labels)
    assert audit_of(spark, rows, labels, ["mask", "part", "n"]) == want
    rng.shuffle(rows)
    # Blocks of a text or two, and fingerprints that all collide.
    assert audit_of(spark, rows, labels, block=300) == want
    assert audit_of(spark, rows, labels, fingerprint=lambda text: len(text) % 2) == want


def test_the_audit_of_nothing_and_of_one_document(spark):
    assert audit_of(spark, [], [(1, 1, 1)]) == {}
    got = audit_of(spark, [(1, None, None)], [])
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_copies_travel_once_a_block():
    same = [(i, b"x " * 60, "s") for i in range(1000, 0, -1)] + [(5, b"x " * 60, "s")] * 500 + [(None, b"y", "s")] * 500
    routed = list(filter_audit.routed(iter(same), filter_audit.xxhash.xxh3_64_intdigest, 1 << 20))
    assert sum(v[0] is not None for _, v in routed) == 1 and len(routed) == 1001
    found = collections.Counter()
    for doc_id, _, mask, n in filter_audit.chained(iter(sorted(routed, key=lambda r: r[0]))):
        found[doc_id is None, bool(mask & filter_audit.COPY)] += n
    assert found == {(False, False): 1, (False, True): 1499, (True, False): 500}


# --- secret scans ---

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+", re.A), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+", re.A), lambda m: len(m[0]) >= 24),
]


def base_of(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
    return sorted(found)


def windows_of(text):
    """Spans of the entropy method, each window counted afresh."""
    out = []
    for k, c in enumerate(secret_scan.CLASSES):
        for m in re.finditer(f"[{c.characters}]{{{secret_scan.WINDOW},}}", text):
            if re.search("|".join(secret_scan.ALLOW), m[0]) or text[: m.start()].endswith(secret_scan.BEFORE):
                continue
            last = None
            for at in range(len(m[0]) - secret_scan.WINDOW + 1):
                w = m[0][at : at + secret_scan.WINDOW]
                counts = collections.Counter(w.lower() if c.fold else w)
                bits = -sum(n / len(w) * math.log2(n / len(w)) for n in counts.values())
                assert abs(bits - c.bits) > 1e-4  # no window lies on the threshold, where the fixed point would decide
                capitals, smalls = sum("A" <= x <= "Z" for x in w), sum("a" <= x <= "z" for x in w)
                if bits > c.bits and sum(x.isdigit() for x in w) >= c.digits and capitals + smalls >= c.letters and capitals >= c.capitals and smalls >= c.smalls:
                    if last and at <= last[1]:
                        last[1] = at + len(w)
                    else:
                        last = [at, at + len(w)]
                        out.append((m.start(), 3 + k, last))
    return [(s + span[0], k, s + span[1]) for s, k, span in out]


def listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def check_scan(spark, texts):
    df = documents(spark, [(i, t) for i, t in enumerate(texts)], ["spans", "base", "_text", "word"])
    got = {r.doc_id: r for r in secret_scan.secret_digest(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = base_of(t or "")
        more = [x for x in windows_of(t or "") if not any(b[0] <= x[0] and b[2] >= x[2] for b in base)]
        assert got[i].spans == listed(base + more), t
        assert got[i].base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))


KEY = "q7Zt0PaV3xLm9WbK2sYd8RfG4hJc"


def test_base_spans_and_windows_equal_brute_force(spark):
    rng = random.Random(12)
    parts = [
        "password: hunter22", "Token=abc", "api_key = 'AbC/def+9=='", "APIKEY:xxxxxx", "secret\"\x20\x20:\x20\"a.b-c_d", "token:token :abcdefg", "token=token=abcdef", "ſecret=longenough", "AKIA" + "Z9" * 8, "AKIA123", "AKIAAKIA" + "Q1" * 9,
        "deadbeef" * 3, "0123456789abcdef" * 2, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", KEY, "a" * 25, "thequickbrownfoxjumpsoverthelazydog", "x" * 30 + KEY + "y" * 45 + KEY[::-1], "https://host/" + KEY, "//" + KEY, ";base64," + KEY, "EXAMPLE" + KEY,
        "é😀", " ", "\n", " ", ", ", "\t", "passwd", "=", "word", "sha256-" + KEY, "9807915762804490123456", "\x00",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "é"]) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    texts += [None, "", LONG, *parts, " ".join(rng.choice(parts) for _ in range(3000))]
    check_scan(spark, texts)


def test_windows_find_what_no_pattern_names_and_leave_prose_alone(spark):
    rng = random.Random(13)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    secrets = ["".join(rng.choice(chars) for _ in range(40)) for _ in range(100)]
    prose = ["a_snake_case_name_that_goes_on_and_on", "Donaudampfschifffahrtsgesellschaft1879", "1234567890123456789012", "ACamelCaseNameOfSomeLongClass2", "550e8400-e29b-41d4-a716-446655440000", "2024-01-01_2024-02-02_report_final_v2", "-" * 60, "=" * 45]
    df = documents(spark, [(i, f"see {t} here") for i, t in enumerate(secrets + prose)])
    got = {r.doc_id: r.spans for r in secret_scan.secret_digest(df).collect()}
    assert sum("base64:" in got[i] for i in range(100)) >= 95
    assert not [prose[i - 100] for i in range(100, 100 + len(prose)) if got[i]]
    assert sum(v.split(":")[1:] == ["4", "44"] for v in got.values()) >= 70  # the rest lose a few characters at an end


def test_scans_of_awkward_rows(spark):
    got = secret_scan.secret_digest(documents(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert secret_scan.secret_digest(documents(spark, [])).count() == 0
    many = " ".join(["AKIA" + "Z9" * 8] * 20000)  # places are summed by doubling
    row = secret_scan.secret_digest(documents(spark, [(1, many)])).first()
    assert row.n_access == 20000 and row.spans.endswith(f"access:{len(many) - 20}:{len(many)}")
    plan = secret_scan.secret_digest(documents(spark, AWKWARD))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


# --- centroid clustering ---


def clustered(rows, clusters=8, rounds=10, size=64):
    """vec_id, cluster, distance, inertia of the cluster, inertia, digest by brute force."""
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    for _ in range(rounds):
        of = [min(range(len(c)), key=lambda k: (far(v, c[k]), k)) for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == k]
            if mine:
                c[k] = [sum(xs) // len(mine) for xs in zip(*mine, strict=True)]
    of = [min(range(len(c)), key=lambda k: (far(v, c[k]), k)) for _, v in kept]
    d = [far(v, c[o]) for (_, v), o in zip(kept, of, strict=True)]
    fits = lambda v: v if v < 1 << 63 else None
    return sorted(((i, o, fits(x), fits(sum(y for y, p in zip(d, of, strict=True) if p == o)), fits(sum(d)), hashlib.sha256(",".join(map(str, c[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, of, d, strict=True)), key=str)


def check_clusters(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("cluster", F.lit(1))
    got = sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=str)
    want = clustered(rows, options.get("clusters", 8), options.get("rounds", 10), options.get("size", 64))
    assert got == want


def test_clusters_equal_brute_force(spark):
    rng = random.Random(14)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(150)]
    rows += [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [math.nan] + [0.0] * 63), (205, [None] + [0.0] * 63), (206, [math.inf] + [0.0] * 63)]
    rows += [(300, [0.5] * 64)] * 40 + [(None, [-0.5] * 64)] * 3 + [(300, [0.25] * 64)]
    check_clusters(spark, rows)
    check_clusters(spark, rows[:5])
    check_clusters(spark, rows[150:155])
    check_clusters(spark, [])


def test_ties_and_large_components(spark):
    # On a grid of few points distances are equal again and again: the lowest number wins, and nothing but integers can say so.
    rng = random.Random(15)
    grid = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)]
    check_clusters(spark, grid, size=4, clusters=6, rounds=5)
    large = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 5, 6, 9, 20, 305]) for _ in range(4)]) for i in range(60)] + [(100 + i, [rng.random() for _ in range(4)]) for i in range(60)]
    check_clusters(spark, large, size=4, clusters=5, rounds=3)


def test_screening_never_loses_the_nearest():
    rng = np.random.default_rng(16)
    for scale in (3, 1000, 1 << 20, 1 << 27):
        c = rng.integers(-scale, scale, (8, 64))
        # Between two centroids, nearly or exactly in the middle.
        x = (c[rng.integers(0, 8, 400)] + c[rng.integers(0, 8, 400)]) // 2 + rng.integers(-1, 2, (400, 64))
        x = np.clip(np.concatenate([x, rng.integers(-scale, scale, (100, 64))]), -centroids.LARGEST, centroids.LARGEST)
        exact = np.array([[int(sum((int(a) - int(b)) ** 2 for a, b in zip(v, k, strict=True))) for k in c] for v in x], dtype=object)
        maybe = centroids.screened(x, c)
        assert all(maybe[r, k] for r in range(len(x)) for k in range(8) if exact[r, k] == min(exact[r]))
        assert (centroids.nearest(x, c) == [min(range(8), key=lambda k: (exact[r, k], k)) for r in range(len(x))]).all()
    # Of random vectors the screening leaves hardly any to integers.
    x, c = rng.integers(-300, 300, (2000, 64)), rng.integers(-300, 300, (8, 64))
    assert (centroids.screened(x, c).sum(1) > 1).mean() < 0.01
