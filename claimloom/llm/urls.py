"""URL filters, in DataFrame operations only.

A curated list of (host, path) rules decides first; the longest rule that fits wins. Other urls are
judged by association rules: FP-growth over the token sets of labelled urls, with the label as an
item, gives combinations of tokens that imply a bad page; rules short of support, confidence or
lift, and rules that a shorter one makes redundant, are pruned. The rules form an inverted index
from token to rules; a url's tokens look their rules up, and a rule matches when all its tokens
have named it.

All tokens of a labelled url are items. Those short of support among the bad, of which no rule can
hold, are left out first; those that are only on bad urls are rules by themselves and make every
longer one redundant. What is left of a url is mined by FP-growth if no url keeps more than
MAX_TOKENS, as its itemsets double with every token; else patterns grow token by token over projected
urls, which counts the same sets. Antecedents have up to MAX_ANTECEDENT tokens, by definition, as in the
query's SQL: sets of tokens that go together would else double with every token.

All rules that no shorter one makes redundant form the model: up to MAX_RULES fit in an expression
and need no join or shuffle; more are an index table, each under the token that the fewest rules
have, joined to the distinct token sets of the urls. All labelled urls are mined, all urls judged by
all of their tokens.

Defined cases: a null url or one without "://" has an empty host and path and no tokens, so it is
allowed; null labels count as not bad; several labels of an id count as bad if one is; without
labelled urls there are no mined rules; of rules that match, the most confident counts, then the
most frequent, then the first by its tokens; very long urls give all their tokens; an empty table
gives an empty result; repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path)
CURATED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_TOKENS, MAX_ANTECEDENT, MAX_RULES = 12, 3, 1000
MIN_COUNT, MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 20, 0.001, 0.6, 1.5
_BAD = "y:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def curated_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = CURATED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct host labels, path segments (digits as #), file endings and query keys."""
    named = lambda xs, kind: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    segments = F.split(F.regexp_replace(F.lower(path), "[0-9]+", "#"), "/")
    keys = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"[?]([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    return F.array_distinct(F.concat(named(F.split(host, "[.]"), "h:"), named(segments, "p:"), named(keys, "q:")))


def tokenised(pages: DataFrame) -> DataFrame:
    """page_id, host, path, tokens."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    slim = slim.withColumn("host", host).withColumn("path", path)
    return slim.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def grown(urls: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """tokens, c, cb: sets of 2 to MAX_ANTECEDENT items on least bad urls, by pattern growth; urls: items (sorted), n, b."""
    level = urls.select(F.array().cast("array<string>").alias("tokens"), F.col("items").alias("rest"), "n", "b")
    found = []
    for size in range(1, MAX_ANTECEDENT + 1):
        longer = level.select("tokens", "rest", "n", "b", F.posexplode("rest").alias("at", "token"))
        longer = longer.select(F.concat("tokens", F.array("token")).alias("tokens"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"), "n", "b")
        sets = scratch.keep(longer.groupBy("tokens").agg(F.sum("n").alias("c"), F.sum("b").alias("cb")).filter(F.col("cb") >= least), "sets")
        if size > 1:
            found.append(sets)
        # A set that is only on bad urls is a rule if any is, and makes those that contain it redundant.
        level = longer.join(sets.filter(F.col("c") > F.col("cb")).select("tokens"), "tokens", "left_semi")
    return found[0].unionByName(found[1])


def fp_grown(urls: DataFrame, least: int) -> DataFrame:
    """The same sets by FP-growth, in which the label is an item, as far as their confidence is enough."""
    bad = F.array_repeat(F.concat("items", F.array(F.lit(_BAD))), F.col("b").cast("int"))
    items = urls.select(F.explode(F.concat(bad, F.array_repeat("items", (F.col("n") - F.col("b")).cast("int")))).alias("items"))
    n = urls.agg(F.sum("n")).first()[0]
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(items)
    rules = model.associationRules.filter(F.size("antecedent").between(2, MAX_ANTECEDENT) & (F.col("consequent") == F.array(F.lit(_BAD))))
    cb = F.round(F.col("support") * n).cast("long")
    return rules.select(F.array_sort("antecedent").alias("tokens"), F.round(cb / F.col("confidence")).cast("long").alias("c"), cb.alias("cb"))


def mine(labelled: DataFrame) -> DataFrame | None:
    """tokens, confidence, count (support) of the rules kept; labelled: tokens, bad. None without bad urls."""
    scratch = Scratch(labelled.sparkSession, "urls")
    urls = labelled.filter((F.size("tokens") > 0) | F.col("bad")).groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    urls = scratch.keep(urls, "labelled")
    n, bad = urls.agg(F.sum("n"), F.sum("b")).first()
    if not bad:
        return None
    least = math.ceil(min(1.0, max(MIN_SUPPORT, MIN_COUNT / n)) * n)
    tokens = urls.select("tokens", "n", "b", F.explode("tokens").alias("token"))
    single = scratch.keep(tokens.groupBy("token").agg(F.sum("n").alias("c"), F.sum("b").alias("cb")).filter(F.col("cb") >= least), "single")
    open_ = single.filter(F.col("c") > F.col("cb")).select("token")
    rest = tokens.join(open_, "token").groupBy("tokens").agg(F.first("n").alias("n"), F.first("b").alias("b"), F.array_sort(F.collect_set("token")).alias("items"))
    rest = scratch.keep(rest.filter(F.size("items") > 1).groupBy("items").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "rest")
    longest = rest.agg(F.max(F.size("items"))).first()[0]
    sets = single.select(F.array("token").alias("tokens"), "c", "cb")
    if longest:
        sets = sets.unionByName(fp_grown(rest, least) if longest <= MAX_TOKENS else grown(rest, least, scratch))
    rules = sets.select("tokens", (F.col("cb") / F.col("c")).alias("confidence"), F.col("cb").alias("count"))
    rules = rules.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("confidence") / F.lit(bad / n) >= MIN_LIFT))
    return scratch.keep(pruned(scratch.keep(rules, "rules")), "kept")


def pruned(rules: DataFrame) -> DataFrame:
    """The rules that no rule of some of their tokens equals in confidence."""
    less_one = F.when(F.size("tokens") > 2, F.transform("tokens", lambda x: F.array_except("tokens", F.array(x)))).otherwise(F.array().cast("array<array<string>>"))
    less_two = F.when(F.size("tokens") > 1, F.transform("tokens", lambda x: F.array(x))).otherwise(F.array().cast("array<array<string>>"))
    shorter = rules.select(F.col("tokens").alias("rule"), F.col("confidence").alias("own"), F.explode(F.concat(less_two, less_one)).alias("tokens"))
    beaten = shorter.join(rules, "tokens").filter(F.col("confidence") >= F.col("own")).select(F.col("rule").alias("tokens")).distinct()
    return rules.join(beaten, "tokens", "left_anti")


def matched_rules(tokens: Column, rules: Sequence[tuple[tuple[str, ...], float, int]]) -> Column:
    """Numbers of the rules whose tokens are all there, through the index token -> rules."""
    index = defaultdict(list)
    for k, (names, _, _) in enumerate(rules):
        for name in names:
            index[name].append(k)
    if not index:
        return F.array().cast("array<int>")
    postings = F.create_map(*(x for name, ks in index.items() for x in (F.lit(name), F.array(*map(F.lit, ks)))))
    sizes = F.array(*(F.lit(len(names)) for names, _, _ in rules))
    known = F.array_intersect(tokens, F.array(*map(F.lit, index)))
    named = F.flatten(F.transform(known, lambda t: postings[t]))
    return F.filter(F.array_distinct(named), lambda k: F.size(F.filter(named, lambda j: j == k)) == F.get(sizes, k))


def matched_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls with mined, the first rule whose tokens are all there, through a table of the index."""
    uses = rules.select("tokens", "confidence", "count", F.explode("tokens").alias("token"))
    uses = uses.join(uses.groupBy("token").agg(F.count(F.lit(1)).alias("uses")), "token")
    best = F.struct(-F.col("confidence"), -F.col("count"), "tokens")
    index = uses.groupBy(F.col("tokens").alias("rule")).agg(F.min(F.struct("uses", "token")).alias("x"), F.first(best).alias("best")).select(F.col("x.token").alias("token"), "rule", "best")
    sets = urls.select("tokens").distinct()
    found = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    found = found.groupBy("tokens").agg(F.array_join(F.min("best")["tokens"], " ").alias("mined"))
    return urls.join(found, "tokens", "left")


def matched(urls: DataFrame, rules: DataFrame | None) -> DataFrame:
    """urls with mined: the best of the rules that match, as text."""
    if rules is None:
        return urls.withColumn("mined", F.lit(None).cast("string"))
    if rules.count() > MAX_RULES:
        return matched_table(urls, rules)
    kept = [(tuple(r.tokens), r.confidence, r["count"]) for r in rules.orderBy(F.desc("confidence"), F.desc("count"), "tokens").collect()]
    names = F.array(*(F.lit(" ".join(t)) for t, _, _ in kept)) if kept else F.array().cast("array<string>")
    return urls.withColumn("mined", F.get(names, F.array_min(matched_rules(F.col("tokens"), kept))))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = CURATED) -> DataFrame:
    """page_id, host, path, rule, verdict, mined: the first mined rule that matches, as text.

    labels: doc_id, quality, toxic; a page is labelled by the row of its own id.
    """
    urls = tokenised(pages)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad"))
    mined = mine(urls.join(marks, "page_id").select("tokens", "bad"))
    rule, listed = curated_rule(F.col("host"), F.col("path"), rules)
    out = matched(urls, mined).select("page_id", "host", "path", rule.alias("rule"), listed.alias("listed"), "mined")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"), "mined")


def oracle_sql() -> str:
    """The same in DuckDB: itemsets of up to three tokens counted outright."""
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in sorted(CURATED, key=lambda r: -len(r[1]) - len(r[2]))) + " END"
    return f"""
WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
t AS (SELECT page_id, host, path,
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x) ||
  list_transform(list_filter(string_split(regexp_replace(lower(path), '[0-9]+', '#', 'g'), '/'), lambda x: x <> ''), lambda x: 'p:' || x) ||
  list_transform(list_filter(list_transform(string_split(regexp_extract(coalesce(url, ''), '[?]([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x) AS raw FROM u),
tok AS (SELECT page_id, host, path, raw, list_distinct(raw) AS tokens FROM t),
m AS (SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY 1),
lab AS (SELECT row_number() OVER () AS k, bad, list_distinct(list_sort(tokens)) AS toks FROM tok JOIN m ON m.doc_id = tok.page_id WHERE len(tokens) > 0 OR bad),
n AS (SELECT count(*) AS n, count(*) FILTER (bad) AS nbad FROM lab),
one AS (SELECT k, bad, unnest(toks) AS a FROM lab),
sets AS (SELECT k, bad, [a] AS s FROM one
  UNION ALL SELECT x.k, x.bad, [x.a, y.a] FROM one x JOIN one y ON x.k = y.k AND x.a < y.a
  UNION ALL SELECT x.k, x.bad, [x.a, y.a, z.a] FROM one x JOIN one y ON x.k = y.k AND x.a < y.a JOIN one z ON x.k = z.k AND y.a < z.a),
freq AS (SELECT s, count(*) AS c, count(*) FILTER (bad) AS cb FROM sets GROUP BY 1),
rules AS (SELECT s, cb::DOUBLE / c AS conf FROM freq, n
  WHERE cb >= ceil(n.n * least(1.0, greatest({MIN_SUPPORT}, {MIN_COUNT}.0 / n.n))) AND cb::DOUBLE / c >= {MIN_CONFIDENCE} AND (cb::DOUBLE / c) / (n.nbad::DOUBLE / n.n) >= {MIN_LIFT}),
hit AS (SELECT DISTINCT page_id FROM tok JOIN rules ON list_has_all(tok.tokens, rules.s))
SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule,
  coalesce({case(lambda v, h, p: v)}, CASE WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM tok"""
