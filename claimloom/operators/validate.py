"""Validation: every issue code is a rule over the rows of one registry; a report is their union.

A registry's rows are read once for all of its codes: they meet each parent table that a code asks
for in one join, which brings what all codes need of it, and the findings of a row come out of it as
one list. A rule that presupposes another one (bounds need a known document, say) holds back on rows
that did not pass it. Keys are taken first-wins before anything is compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.text import missing, moment, present, strip, text_hash, whole
from claimloom.operators import overlap
from claimloom.operators.dq import first_by_key, issue, key_counts
from claimloom.plans.registry import ACCEPTED_REQUIRED, REQUIRED, REVIEW_STATES, Registry
from claimloom.sources.shared import written

#: Registries with a key, and the key.
KEYED = {"claims": "claim_id", "evidence": "evidence_id", "segments": "segment_id", "entities": "entity_id", "documents": "document_id"}
ERROR, WARNING = "error", "warning"


@dataclass(frozen=True)
class Rule:
    """A code of a registry's rows: what it needs joined, and a list of details, one for each finding."""

    table: str
    level: str
    needs: tuple[str, ...]
    details: Callable[[], Column]


RULES: dict[str, Rule] = {}
#: Codes that are no rule of single rows.
OTHERS: dict[str, Callable[[Registry], DataFrame]] = {}


def _rule(code: str, bad: Callable[[], Column], detail: str | None = None, needs: tuple[str, ...] = (), level: str = ERROR) -> None:
    """A rule that finds one thing in a row at most."""
    found = lambda: F.when(bad(), F.array(F.lit("") if detail is None else F.coalesce(F.col(detail).cast("string"), F.lit(""))))
    RULES[code] = Rule(code.split(".")[0], level, needs, found)


def _fields(code: str, fields: list[str], where: Callable[[], Column] = lambda: F.lit(True)) -> None:
    """A finding for each of the fields that is null or empty."""
    marks = lambda: F.array_compact(F.array(*(F.when(missing(F.col(f)), F.lit(f)) for f in fields)))
    RULES[code] = Rule(code.split(".")[0], ERROR, (), lambda: F.when(where(), marks()))


def _keyed(r: Registry, table: str) -> DataFrame:
    rows = getattr(r, table)
    return first_by_key(rows, KEYED[table], _order(rows))


def _order(rows: DataFrame) -> list[str]:
    """What tells which of a key's rows is the first."""
    return ["ord"] if "ord" in rows.columns else sorted(c for c, t in rows.dtypes if not t.startswith(("map", "variant")))


def _ids(r: Registry, table: str) -> DataFrame:
    return getattr(r, table).select(KEYED[table]).distinct()


#: What a need brings: the rows' reference, the parents by key, and their columns under new names; "known" marks that there is one.
_PARENTS: dict[str, dict[str, tuple[str, Callable[[Registry], DataFrame], str, dict[str, str]]]] = {
    "documents": {"type": ("document_type", lambda r: r.document_types.select("key").distinct(), "key", {})},
    "segments": {"document": ("document_id", lambda r: _keyed(r, "documents"), "document_id", {"of_type": "document_type", "body": "text"})},
    "claims": {
        "relation": ("predicate", lambda r: r.relations.select("key").distinct(), "key", {}),
        "subject": ("subject_id", lambda r: _ids(r, "entities"), "entity_id", {}),
        "object": ("object_id", lambda r: _ids(r, "entities"), "entity_id", {}),
        "document": ("source_document_id", lambda r: _ids(r, "documents"), "document_id", {}),
        "segment": ("source_segment_id", lambda r: _keyed(r, "segments"), "segment_id", {"segment_document": "document_id"}),
        "support": ("claim_id", lambda r: _keyed(r, "evidence").filter(F.lower(strip(F.col("support"))) == "support").select("claim_id").distinct(), "claim_id", {}),
    },
    "evidence": {
        "claim": ("claim_id", lambda r: _ids(r, "claims"), "claim_id", {}),
        "document": ("source_document_id", lambda r: _keyed(r, "documents").select("document_id", F.length("text").alias("size")), "document_id", {"body_size": "size"}),
        "segment": ("source_segment_id", lambda r: _keyed(r, "segments"), "segment_id", {"segment_document": "document_id", "segment_start": "start_char", "segment_end": "end_char"}),
    },
    "derived": {
        "claim": ("source_claim_id", lambda r: _keyed(r, "claims"), "claim_id", {"state": "status"}),
        "relation": ("predicate", lambda r: r.relations.select("key").distinct(), "key", {}),
        "rule": ("rule_key", lambda r: r.rules.select("key").distinct(), "key", {}),
    },
    "document_types": {},
}


def _known(need: str) -> Column:
    return F.col(f"known_{need}").isNotNull()


def _dangling(need: str, column: str) -> Callable[[], Column]:
    return lambda: present(F.col(column)) & ~_known(need)


def _judged(rows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """The rows with these rules' findings added to the list that they carry; null where there are none, as in most rows."""
    lists = [_listed(code, rule) for code, rule in rules.items()]
    if "__found" in rows.columns:
        lists.append(F.coalesce("__found", F.array().cast(_FOUND)))
    return rows.withColumn("__found", F.when(F.size(F.concat(*lists)) > 0, F.concat(*lists))) if lists else rows


def _odd_segment(rows: DataFrame) -> Column:
    """Whether a segment's id is given as something other than a string, which the row's text tells where it is kept."""
    if "raw" not in rows.columns:
        return F.lit(False)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("raw"), "$.source_segment_id", "variant"))
    return F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))


_STATES = list(REVIEW_STATES)


def _ok() -> Column:
    """Claims whose state is one of the five; other rules of a claim presuppose that."""
    return F.coalesce(F.col("status").isin(_STATES), F.lit(False))


def _accepted() -> Column:
    return F.coalesce(F.col("status") == "accepted", F.lit(False))


def _start() -> Column:
    return whole(F.col("start_char"))


def _end() -> Column:
    return whole(F.col("end_char"))


_rule("document_types.invalid_default_claim_status", lambda: ~F.col("default_claim_status").eqNullSafe(F.lit("proposed")), "default_claim_status")
_rule("documents.missing_type", lambda: missing(F.col("document_type")))
_rule("documents.unknown_type", _dangling("type", "document_type"), "document_type", ("type",))

for _table in ("claims", "evidence", "segments"):
    _fields(f"{_table}.missing_field", REQUIRED[_table])
_rule("segments.unknown_document", lambda: ~_known("document"), "document_id", ("document",))
_IN_DOCUMENT: dict[str, tuple[Callable[[], Column], str | None]] = {
    "document_type_mismatch": (lambda: present(F.col("document_type")) & present(F.col("of_type")) & (F.col("document_type") != F.col("of_type")), "of_type"),
    "invalid_numeric_field": (lambda: F.greatest(*(whole(F.col(c)).isNull().cast("int") for c in ("start_char", "end_char", "ordinal"))) == 1, None),
    "invalid_offsets": (lambda: _start() > _end(), None),
    "text_hash_mismatch": (lambda: ~text_hash(F.col("text")).eqNullSafe(F.col("text_hash")), None),
    "out_of_bounds": (lambda: _end() > F.length("body"), None),
    "text_mismatch": (
        lambda: (_end() <= F.length("body")) & ~F.substring("body", (_start() + 1).cast("int"), F.greatest(_end() - _start(), F.lit(0)).cast("int")).eqNullSafe(F.col("text")), None,
    ),
}
for _name, (_bad, _detail) in _IN_DOCUMENT.items():
    _rule(f"segments.{_name}", lambda bad=_bad: _known("document") & bad(), _detail, ("document",))

_rule("claims.invalid_status", lambda: ~_ok(), "status")
_rule("claims.invalid_review_state", lambda: _ok() & ~F.create_map(*(F.lit(x) for pair in REVIEW_STATES.items() for x in pair))[F.col("status")].eqNullSafe(F.col("review_state")), "review_state")
for _code, _need, _column in (("relation", "relation", "predicate"), ("subject", "subject", "subject_id"), ("object", "object", "object_id"), ("document", "document", "source_document_id")):
    _rule(f"claims.unknown_{_code}", lambda bad=_dangling(_need, _column): _ok() & bad(), _column, (_need,))
for _table, _where in (("claims", _ok), ("evidence", lambda: F.lit(True))):
    _rule(f"{_table}.invalid_segment_id", lambda where=_where: where() & F.col("odd_segment"), "source_segment_id")
    _rule(f"{_table}.unknown_segment", lambda where=_where: where() & ~F.col("odd_segment") & _dangling("segment", "source_segment_id")(), "source_segment_id", ("segment",))
    _rule(
        f"{_table}.segment_document_mismatch", lambda where=_where: where() & ~F.col("odd_segment") & _known("segment") & present(F.col("source_document_id")) & ~F.col("segment_document").eqNullSafe(F.col("source_document_id")),
        "segment_document", ("segment",),
    )
_fields("claims.accepted_missing_review_metadata", ACCEPTED_REQUIRED, _accepted)
_rule("claims.invalid_decision_actor", lambda: _accepted() & present(F.col("decision_by")) & ~F.col("decision_by").startswith("human:"), "decision_by")
_rule("claims.accepted_without_evidence", lambda: _accepted() & ~_known("support"), None, ("support",))
_rule("claims.disputed", lambda: F.coalesce(F.col("status") == "disputed", F.lit(False)), level=WARNING)
_rule("claims.explicit_contradiction", lambda: _accepted() & (F.col("predicate") == "contradicts"), level=WARNING)

for _need, _column in (("claim", "claim_id"), ("document", "source_document_id")):
    _rule(f"evidence.unknown_{_need}", _dangling(_need, _column), _column, (_need,))
_SPAN = lambda: F.coalesce(_start() <= _end(), F.lit(False))
_rule("evidence.invalid_offsets", lambda: _known("segment") & ~_SPAN(), None, ("segment",))
_rule("evidence.out_of_segment_bounds", lambda: _known("segment") & _SPAN() & ((_start() < F.col("segment_start")) | (_end() > F.col("segment_end"))), None, ("segment",))
_rule("evidence.out_of_document_bounds", lambda: _known("segment") & _SPAN() & _known("document") & (_end() > F.col("body_size")), None, ("segment", "document"))

_fields("derived.missing_field", REQUIRED["derived"])
_rule("derived.unknown_source_claim", _dangling("claim", "source_claim_id"), "source_claim_id", ("claim",))
_rule("derived.non_accepted_source_claim", lambda: _known("claim") & ~F.col("state").eqNullSafe(F.lit("accepted")), "state", ("claim",))
_rule("derived.unknown_predicate", _dangling("relation", "predicate"), "predicate", ("relation",))
_rule("derived.unknown_rule", _dangling("rule", "rule_key"), "rule_key", ("rule",))
_KEY_OF = {**KEYED, "derived": "edge_id", "document_types": "key"}


_FOUND = "array<struct<level: string, code: string, detail: string>>"


def _listed(code: str, rule: Rule) -> Column:
    """The rule's findings in a row: level, code, detail."""
    details = F.coalesce(rule.details(), F.array().cast("array<string>"))
    return F.transform(details, lambda d: F.struct(F.lit(rule.level).alias("level"), F.lit(code).alias("code"), d.alias("detail")))


def findings(r: Registry, table: str, codes: Iterable[str]) -> DataFrame:
    """level, code, record, detail of these codes' rules over a registry's rows, in one pass.

    A rule is judged as soon as what it needs is joined, those that need nothing before any row moves: so
    a shuffle carries the findings made so far and the columns that later rules read, not whole rows.
    """
    rules, rows = {c: RULES[c] for c in codes}, getattr(r, table)
    order = _order(rows)
    if table in ("claims", "evidence"):
        rows = rows.withColumn("odd_segment", _odd_segment(rows))
    rows = _judged(rows, {c: x for c, x in rules.items() if not x.needs})
    if table in KEYED:
        rows = first_by_key(rows, KEYED[table], order)
    joined: set[str] = set()
    for need in sorted({n for rule in rules.values() for n in rule.needs}):
        column, parents, key, brings = _PARENTS[table][need]
        rows = rows.join(parents(r).select(F.col(key).alias(column), F.lit(True).alias(f"known_{need}"), *(F.col(v).alias(k) for k, v in brings.items())), column, "left")
        joined.add(need)
        rows = _judged(rows, {c: x for c, x in rules.items() if need in x.needs and joined.issuperset(x.needs)})
    found = rows.select(F.coalesce(F.col(_KEY_OF[table]).cast("string"), F.lit("")).alias("record"), F.explode("__found").alias("f"))
    return found.select("f.level", "f.code", "record", "f.detail")


def _keys(r: Registry, table: str, codes: Iterable[str]) -> DataFrame:
    """Missing and duplicate keys of a registry, from one count of its keys."""
    counts, key = key_counts(getattr(r, table), KEYED[table]), F.col("key")
    kind = F.when(key.isNull(), f"{table}.missing_key").when(F.col("n") > 1, f"{table}.duplicate_key")
    found = counts.select(kind.alias("code"), F.coalesce(key, F.lit("")).alias("record"), (F.col("n") - key.isNotNull().cast("int")).cast("string").alias("detail"))
    return found.filter(F.col("code").isin(list(codes))).select(F.lit(ERROR).alias("level"), "code", "record", "detail")


def exclusive_conflicts(r: Registry) -> DataFrame:
    """claim_id, other: accepted claims of one subject and exclusive relation whose objects differ while both hold.

    Time bounds that are absent, or no moments, are open.
    """
    single = r.relations.filter("exclusive_object").select(F.col("key").alias("predicate"))
    rows = _keyed(r, "claims").filter("status = 'accepted'").join(single, "predicate", "left_semi")
    low, high = F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit("9999-12-31 23:59:59").cast("timestamp")
    rows = rows.select("claim_id", "subject_id", "predicate", "object_id", F.coalesce(moment(F.col("valid_from")), low).alias("f"), F.coalesce(moment(F.col("valid_to")), high).alias("t"))
    return overlap.pairs(rows.filter("subject_id IS NOT NULL AND predicate IS NOT NULL"), ["subject_id", "predicate"], "claim_id", "object_id").select(F.col("first").alias("claim_id"), F.col("second").alias("other"))


OTHERS["claims.exclusive_object_conflict"] = lambda r: issue(exclusive_conflicts(r), WARNING, "claims.exclusive_object_conflict", F.col("claim_id"), F.col("other"))
_KEY_CODES = {f"{t}.{c}": t for t in KEYED for c in ("missing_key", "duplicate_key")}
#: Every code that is looked for.
CODES = [*_KEY_CODES, *RULES, *OTHERS]


def issues(r: Registry, codes: Iterable[str] | None = None) -> DataFrame:
    """All findings of the codes named, or of all that the registry has the tables for."""
    named = list(codes) if codes is not None else [c for c in CODES if r.derived is not None or not c.startswith("derived.")]
    parts = [_keys(r, t, mine) for t in KEYED if (mine := [c for c in named if _KEY_CODES.get(c) == t])]
    parts += [findings(r, t, mine) for t in _PARENTS if (mine := [c for c in named if c in RULES and RULES[c].table == t])]
    parts += [OTHERS[c](r) for c in named if c in OTHERS]
    # Findings are few beside the rows: of several parts each is written, and its shuffles go before the next is made.
    return reduce(DataFrame.unionByName, (written(p, "findings") for p in parts) if len(parts) > 1 else parts)


def summary(found: DataFrame) -> DataFrame:
    """One row: errors, warnings, status."""
    counts = found.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return counts.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "passed_with_warnings").otherwise("passed"))


def index_issues(indexed_hash: str | None, current_hash: str | None, strict: bool = False) -> list[tuple[str, str]]:
    """(level, code) of an index's freshness: by the hash of the segments that it was made of."""
    level = "error" if strict else "warning"
    if current_hash is None:
        return []
    if indexed_hash is None:
        return [(level, "retrieval.index_missing")]
    return [] if indexed_hash == current_hash else [(level, "retrieval.index_stale")]


def mirror_issues(ledger: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """A finding for each source whose ledger row is missing or names another hash, count or version."""
    l = ledger.select("source_path", F.col("source_hash").alias("h"), F.col("row_count").alias("n"), F.col("schema_version").alias("v"), F.lit(True).alias("there"))
    both = sources.join(l, "source_path", "left")
    same = F.col("there") & F.col("h").eqNullSafe(F.col("source_hash")) & F.col("n").eqNullSafe(F.col("row_count")) & F.col("v").eqNullSafe(F.col("schema_version"))
    return issue(both.filter(~F.coalesce(same, F.lit(False))), "error" if strict else "warning", "mirror.stale", F.col("source_path"))
