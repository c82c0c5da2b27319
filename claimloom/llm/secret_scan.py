"""Secret scans, in DataFrame functions only: patterns, and the entropy of a window that slides over long strings.

Patterns name spans of three kinds (BASE). A span's place comes from the lengths of the parts that
lie between matches, summed by doubling (n log n for n matches).

The method finds what no pattern names. Candidates are runs of the characters of a class (CLASSES).
A window of WINDOW characters slides over each; for every step one character enters and one leaves,
their counts change by one, and the sum of g(count), g(c) = c log2 c in fixed point, by two
differences: H = log2(WINDOW) - sum / WINDOW, exact and the same in any order. Windows that reach
the class's entropy and hold the kinds of characters that it asks for are joined where they touch or
overlap. Candidates that the allow list (ALLOW, BEFORE) knows, and joined spans inside a span of a pattern, are left out.

One pass over the rows, no shuffle: every row is a function of its text. A text is looked at twice,
for assignments and for long runs; all else is done in the runs. Cost grows with the text's length,
and a fold's with the candidate's.

Defined cases: a null or empty text has no spans, and the digest of no spans is that of the empty
text; very long texts are scanned whole; repeated rows repeat; spans of one start stand in the order
of their kinds, then of their ends; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind, pattern (Java and RE2 read it alike), group and least length of what it found.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = (
    ("assign", rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", "[0-9a-f]{24,}", 0, 24),
)


class Class(NamedTuple):
    """Strings of one kind of characters, the bits of entropy of a window, and the counts of digits, capitals and small letters that it needs."""

    kind: str
    characters: str
    bits: float
    fold: bool  #: whether capitals count as the small letters
    digits: int
    letters: int
    capitals: int
    smalls: int


WINDOW = 20
CLASSES = (Class("hexits", "0-9A-Fa-f", 2.9, True, 2, 2, 0, 0), Class("base64", "A-Za-z0-9+/_=-", 3.7, False, 2, 2, 2, 2))
KINDS = [*(b[0] for b in BASE), *(c.kind for c in CLASSES)]
#: Candidates that are no secrets, by themselves: placeholders, runs through the alphabet or the digits, ids, digests of files, paths of urls.
ALLOW = ("[Ee][Xx][Aa][Mm][Pp][Ll][Ee]", "[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd]", "[Xx]{6}", "[Aa][Bb][Cc][Dd][Ee][Ff][Gg][Hh]", "0123456789", "123456789", "^//", "^sha(256|384|512)-", "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
#: And by what stands before them: data in a page.
BEFORE = ";base64,"
#: Every candidate and every span of access or hex lies in such a run, so that the text is looked at once for all of them.
_LONG = f"[{CLASSES[1].characters}]{{{WINDOW},}}"
_UNIT = 1 << 20
#: g(0) to g(WINDOW), in units.
G = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1))]
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _limit(bits: float) -> int:
    """The most that the sum of g may be."""
    return G[WINDOW] - math.ceil(WINDOW * bits * _UNIT)


def prefix_sums(numbers: Column) -> Column:
    """Of an array, each element with those before it: by doubling, as appending to an array copies it."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda s: s < F.size(numbers))
    return F.aggregate(steps, numbers, lambda a, s: F.transform(a, lambda x, i: x + F.when(i >= s, F.get(a, i - s)).otherwise(F.lit(0).cast("long"))))


def placed(found: Column, gaps: Column) -> Column:
    """struct(word, start, before) of a pattern's matches, from them and the parts between them."""
    length = lambda x: F.length(x).cast("long")
    ends = prefix_sums(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: length(g) + length(m)))
    return F.slice(F.zip_with(F.arrays_zip(found.alias("word"), gaps.alias("before")), ends, lambda m, e: F.struct(m["word"].alias("word"), (e - length(m["word"])).alias("start"), m["before"].alias("before"))), 1, F.size(found))


def matches(text: Column, pattern: str) -> Column:
    """struct(word, start, before) of all matches, leftmost and without overlap; before: what lies between it and the one before."""
    return placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))


def inside_runs(runs: Column, pattern: str) -> Column:
    """The same for a pattern all of whose matches lie in the runs, without another look at the text."""
    at = lambda r: F.transform(matches(r["word"], pattern), lambda m: F.struct(m["word"].alias("word"), (r["start"] + m["start"]).alias("start"), F.when(m["start"] == 0, r["before"]).otherwise(m["before"]).alias("before")))
    return F.flatten(F.transform(F.filter(runs, lambda r: r["word"].rlike(pattern)), at))


def base_spans(assigned: Column, runs: Column) -> Column:
    """Of all patterns, by start, kind and end: of those that assign from their own matches, of the others from the runs."""
    spans = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        found = F.filter(assigned, lambda m: F.length(F.regexp_extract(m["word"], pattern, group)) >= least) if group else inside_runs(runs, pattern)  # noqa: B023  used at once
        spans.append(F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["word"])).alias("end"))))  # noqa: B023
    return F.array_sort(F.concat(*spans))


def windows(word: Column, of: Class) -> Column:
    """Joined windows of a candidate that pass: array of struct(at, to) inside it, from a fold over its characters."""
    letters = F.split(F.lower(word) if of.fold else word, "")
    as_written = F.split(word, "")
    g = F.array(*(F.lit(x) for x in G))
    none = F.array().cast("array<struct<at:int,to:int>>")
    start = F.struct(F.lit("0" * 96).alias("counts"), F.lit(0).cast("long").alias("sum"), *(F.lit(0).alias(n) for n in ("digits", "capitals", "smalls")), none.alias("spans"))

    def moved(s: Column, i: Column, by: int) -> Column:
        """The state after character i has entered (by 1) or left (by -1)."""
        place = F.ascii(F.get(letters, i)) - 31
        count = F.ascii(F.substring(s["counts"], place, F.lit(1))) - 48
        kind = F.ascii(F.get(as_written, i))
        step = lambda low, high: F.when(kind.between(low, high), by).otherwise(0)
        return F.struct(
            F.overlay(s["counts"], F.char(count + 48 + by), place, F.lit(1)).alias("counts"), (s["sum"] + F.get(g, count + by) - F.get(g, count)).alias("sum"),
            (s["digits"] + step(48, 57)).alias("digits"), (s["capitals"] + step(65, 90)).alias("capitals"), (s["smalls"] + step(97, 122)).alias("smalls"), s["spans"].alias("spans"),
        )

    def judged(s: Column, i: Column) -> Column:
        at, to = (i - (WINDOW - 1)).cast("int"), (i + 1).cast("int")
        last = F.element_at(s["spans"], -1)
        passes = (i >= WINDOW - 1) & (s["sum"] <= _limit(of.bits)) & (s["digits"] >= of.digits) & (s["capitals"] + s["smalls"] >= of.letters) & (s["capitals"] >= of.capitals) & (s["smalls"] >= of.smalls)
        joins = (F.size(s["spans"]) > 0) & (F.when(F.size(s["spans"]) > 0, last["to"]) >= at)
        longer = F.concat(F.slice(s["spans"], F.lit(1), F.size(s["spans"]) - 1), F.array(F.struct(last["at"].alias("at"), to.alias("to"))))
        more = F.concat(s["spans"], F.array(F.struct(at.alias("at"), to.alias("to"))))
        return F.struct(*(s[n].alias(n) for n in ("counts", "sum", "digits", "capitals", "smalls")), F.when(passes & joins, longer).when(passes, more).otherwise(s["spans"]).alias("spans"))

    # A one-element transform binds what a step has made so far, so that it is made once.
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i >= WINDOW, moved(s, i - WINDOW, -1)).otherwise(s)
        return bound(left, lambda a: bound(moved(a, i, 1), lambda b: judged(b, i)))

    return F.aggregate(F.sequence(F.lit(0), F.length(word) - 1), start, step, lambda s: s["spans"])


def entropy_spans(runs: Column, classes: Sequence[Class] = CLASSES, allow: Sequence[str] = ALLOW) -> Column:
    """What the window finds in the runs, before spans of patterns are taken off."""
    spans = []
    for k, of in enumerate(classes):
        needs = [f"[{c}]" for c, n in (("0-9", of.digits), ("A-Za-z", of.letters), ("A-Z", of.capitals), ("a-z", of.smalls)) if n]
        holds = lambda m: F.forall(F.array(*(m["word"].rlike(n) for n in needs)), lambda x: x)  # noqa: B023, E731
        wanted = F.filter(inside_runs(F.filter(runs, holds), f"[{of.characters}]{{{WINDOW},}}"), lambda m: holds(m) & ~m["word"].rlike("|".join(allow)) & ~m["before"].endswith(BEFORE))  # noqa: B023
        spans.append(F.flatten(F.transform(wanted, lambda m: F.transform(windows(m["word"], of), lambda w: F.struct((m["start"] + w["at"]).alias("start"), F.lit(len(BASE) + k).alias("kind"), (m["start"] + w["to"]).alias("end"))))))  # noqa: B023
    return F.concat(*spans)


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, allow: Sequence[str] = ALLOW, classes: Sequence[Class] = CLASSES) -> DataFrame:
    """doc_id, base and spans: arrays of struct(start, kind, end), kind a place in KINDS, for every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    # One look at the text for each of two patterns; a second one only where there are matches.
    patterns = {"_assigned": BASE[0][1], "_runs": _LONG}
    rows = rows.select("doc_id", "_text", *(F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(c) for c, p in patterns.items()))
    gaps = lambda c, p: F.when(F.size(c) > 0, F.split("_text", p, -1)).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", *patterns, *(gaps(c, p).alias(f"{c}_gaps") for c, p in patterns.items()))
    rows = rows.select("doc_id", *(placed(F.col(c), F.col(f"{c}_gaps")).alias(c) for c in patterns))
    rows = rows.select("doc_id", base_spans(F.col("_assigned"), F.col("_runs")).alias("base"), entropy_spans(F.col("_runs"), classes, allow).alias("_more"))
    inside = lambda s: F.exists("base", lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", F.filter("_more", lambda s: ~inside(s)))).alias("spans"))


def secret_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: the spans listed as kind:start:end."""
    found = scan(documents)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k) for k in range(len(BASE))), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _sql_spans(kind: int, pattern: str, condition: str = "true") -> str:
    """doc, kind, word, before, s (start) of a pattern's matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc, {kind} AS kind, word, before, (sum(length(before) + length(word)) OVER (PARTITION BY doc ORDER BY nth) - length(word))::BIGINT AS s
  FROM (SELECT doc, unnest(regexp_extract_all(t, '{p}')) AS word, unnest(string_split_regex(t, '{p}')[:-2]) AS before, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS nth FROM d WHERE {condition})"""


def oracle_sql() -> str:
    """The same in DuckDB: all windows of all candidates are laid out, and each one's characters counted."""
    group = BASE[0][1].replace("'", "''")
    base = " UNION ALL ".join(f"SELECT doc, kind, s, s + length(word) AS e FROM ({_sql_spans(k, p)})" + (f" WHERE length(regexp_extract(word, '{group}', {g})) >= {n}" if g else "") for k, (_, p, g, n) in enumerate(BASE))
    allow = "|".join(ALLOW)
    candidates = " UNION ALL ".join(f"""SELECT * FROM ({_sql_spans(len(BASE) + k, f"[{c.characters}]{{{WINDOW},}}")})""" for k, c in enumerate(CLASSES))
    limits = "CASE kind " + " ".join(f"WHEN {len(BASE) + k} THEN sum(list_extract([{', '.join(map(str, G))}]::BIGINT[], (n + 1)::BIGINT)) <= {_limit(c.bits)}" for k, c in enumerate(CLASSES)) + " END"
    enough = "CASE kind " + " ".join(f"WHEN {len(BASE) + k} THEN sum(n * nd) >= {c.digits} AND sum(n * (nc + ns)) >= {c.letters} AND sum(n * nc) >= {c.capitals} AND sum(n * ns) >= {c.smalls}" for k, c in enumerate(CLASSES)) + " END"
    enough = enough.replace("n * nd", "nd").replace("n * (nc + ns)", "nc + ns").replace("n * nc", "nc").replace("n * ns", "ns")
    folds = ", ".join(str(len(BASE) + k) for k, c in enumerate(CLASSES) if c.fold)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
runs AS (SELECT row_number() OVER () AS run, * FROM ({candidates}) WHERE NOT regexp_matches(word, '{allow}') AND NOT suffix(before, '{BEFORE}')),
letters AS (SELECT run, kind, j, w, CASE WHEN kind IN ({folds}) THEN lower(ch) ELSE ch END AS ch, count(*) AS n,
    count(*) FILTER (ch BETWEEN '0' AND '9') AS nd, count(*) FILTER (ch BETWEEN 'A' AND 'Z') AS nc, count(*) FILTER (ch BETWEEN 'a' AND 'z') AS ns
  FROM (SELECT run, kind, j, w, unnest(string_split(w, '')) AS ch FROM (SELECT run, kind, j, substr(word, j + 1, {WINDOW}) AS w FROM (SELECT *, unnest(range(length(word) - {WINDOW - 1})) AS j FROM runs)))
  GROUP BY run, kind, j, w, CASE WHEN kind IN ({folds}) THEN lower(ch) ELSE ch END),
passed AS (SELECT run, kind, j FROM letters GROUP BY run, kind, j HAVING {limits} AND {enough}),
islands AS (SELECT run, kind, j, sum(fresh) OVER (PARTITION BY run ORDER BY j) AS island FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY run ORDER BY j) <= {WINDOW} THEN 0 ELSE 1 END AS fresh FROM passed)),
more AS (SELECT r.doc, i.kind, r.s + i.lo AS s, r.s + i.hi + {WINDOW} AS e FROM (SELECT run, kind, island, min(j) AS lo, max(j) AS hi FROM islands GROUP BY ALL) i JOIN runs r ON r.run = i.run),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (FROM base b WHERE b.doc = m.doc AND b.s <= m.s AND b.e >= m.e)),
listed AS (SELECT doc, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans,
    string_agg(({names})[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (kind < {len(BASE)}) AS base FROM every GROUP BY doc)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc)"""
