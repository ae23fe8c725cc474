"""URL filters by association rules (operator 8), with DataFrame functions only.

Given rules (host, path) decide the pages that they fit; the longest wins. For all others, FP-growth mines combinations
of URL tokens over all pages that a given rule decides, labelled by its verdict, and keeps rules "tokens imply block" of
enough support and confidence; the confidence counts by the rule of succession, (blocked + 1) / (pages + 2), so that tokens
seen on a few decided pages judge no others. Pages without a verdict are what is to be judged and no evidence; only where
the given rules allow no page at all, so that any token would imply block, they count as allowed. Rules with more tokens
than one that already blocks are dropped; the rest are matched by an inverted index from token to rules, within the row.

Rules have `longest` tokens at most (LONGEST unless asked otherwise). FP-growth makes every frequent combination of every
size before any could be dropped, which doubles with each token that URLs share. It is therefore given little to combine,
without losing a rule: tokens on too few blocked pages go; those that imply block by themselves are rules already, so that
longer ones with them would be dropped; tokens that are on the same pages stand for each other; and where URLs still have
more than AT_ONCE tokens, the tokens are dealt into groups, and each choice of `longest` groups, which together hold no
more than AT_ONCE tokens of any URL, is mined by itself: every combination of so many tokens lies in one choice. Where
pages have labels of their own, judge takes them.

Edge cases: a null url, or one without `://`, has empty host and path and is allowed; hosts are lower-cased in A-Z only;
repeated rows get repeated results; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import string
from itertools import combinations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.95
#: Tokens of a mined rule, at most: with it, rules number at most (combinations of so many of a URL's tokens) / MIN_SUPPORT.
LONGEST = 3
#: Tokens of a URL that are mined at once, at most: a run then makes 2^(AT_ONCE + 1) / MIN_SUPPORT combinations at most.
AT_ONCE = 12
BLOCKED = "verdict=block"
#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def split_url(pages: DataFrame) -> DataFrame:
    """pages (page_id, url) with host and path, and rest (what follows the path)."""
    at = F.coalesce(F.instr("url", "://"), F.lit(0))
    pages = pages.select("page_id", F.when(at > 0, F.substring("url", F.lit(1), at - 1)).otherwise("").alias("scheme"), F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("").alias("rest"))
    pages = pages.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0)).withColumn("rest", F.substring("rest", F.length("raw") + 1, F.length("rest")))
    host = F.translate("raw", string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", "scheme", host.alias("host"), F.regexp_extract("rest", "^[^?#]*", 0).alias("path"), F.regexp_extract("rest", r"\?([^#]*)", 1).alias("query"))


def fitting(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a URL: its host and the domains above, path segments, query keys, scheme."""
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host="), F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    named = lambda name, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(name), p))
    keys = F.transform(F.split("query", "&"), lambda p: F.substring_index(p, "=", 1))
    every = F.array_distinct(F.concat(domains, named("path=", F.split("path", "/")), named("query=", keys), F.array(F.concat(F.lit("scheme="), F.col("scheme")))))
    return F.when(F.col("host") != "", every).otherwise(F.array().cast("array<string>"))


class Vocabulary:
    """Tokens on enough blocked pages: those that imply block by themselves, and the rest, by the one that stands for all on the same pages."""

    def __init__(self, labelled: DataFrame, need: int, confidence: float):
        page = F.xxhash64("tokens", F.coalesce("verdict", F.lit("")))
        parts = [F.shiftrightunsigned(page, k * 32).bitwiseAND(F.lit((1 << 32) - 1)).alias(f"h{k}") for k in (0, 1)]
        each = labelled.select(F.explode("tokens").alias("token"), "verdict", *parts)
        found = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("blocked"), F.sum("h0").alias("h0"), F.sum("h1").alias("h1"))
        rows = sorted(found.where(F.col("blocked") >= need).collect(), key=lambda r: (-r.blocked, r.token))  # (tokens of a URL) / support at most
        self.alone = sorted(r.token for r in rows if implies(r.blocked, r.n, confidence))
        self.alike: dict[str, list[str]] = {}
        first: dict[tuple, str] = {}
        for r in rows:
            if not implies(r.blocked, r.n, confidence):
                self.alike.setdefault(first.setdefault((r.n, r.blocked, r.h0, r.h1), r.token), []).append(r.token)


def implies(blocked: int, n: int, confidence: float) -> bool:
    return blocked >= confidence * n and (blocked + 1) / (n + 2) >= confidence


def _of(column: str, tokens: list[str]) -> Column:
    return F.filter(column, lambda t: t.isin(*tokens))


def choices(baskets: DataFrame, tokens: list[str], longest: int) -> list[list[str]]:
    """Sets of tokens that hold every combination of `longest` tokens and at most AT_ONCE tokens of any basket."""
    largest = baskets.agg(F.max(F.size("items"))).first()[0] or 0
    if largest <= AT_ONCE:
        return [tokens]
    groups = math.ceil(longest * largest / AT_ONCE)
    while True:
        groups = min(groups, len(tokens))
        dealt = [tokens[k::groups] for k in range(groups)]  # tokens of like frequency, which meet often, go apart
        inside = F.sort_array(F.array(*(F.size(_of("items", g)) for g in dealt)), asc=False)
        top = F.aggregate(F.slice(inside, 1, longest), F.lit(0), lambda a, x: a + x)
        if groups == len(tokens) or baskets.agg(F.max(top)).first()[0] <= max(AT_ONCE, longest):
            return [[t for g in chosen for t in g] for chosen in combinations(dealt, longest)]
        groups += max(1, groups // 4)


def mine(labelled: DataFrame, support: float, confidence: float, longest: int = LONGEST) -> list[list[list[str]]]:
    """Rules that imply block, smallest first, none containing another: of each part of a rule, any of the listed tokens. labelled: tokens, verdict (null if undecided)."""
    total, decided, allowed = labelled.agg(F.count("*"), F.count("verdict"), F.count_if(F.col("verdict") == "allow")).first()
    if allowed:
        labelled, total = labelled.where("verdict is not null"), decided
    need = max(1, math.ceil(round(support * total, 9)))
    vocabulary = Vocabulary(labelled, need, confidence)
    rules = [[[t]] for t in vocabulary.alone]
    tokens = list(vocabulary.alike)
    if longest < 2 or len(tokens) < 2:
        return rules
    baskets = labelled.select(_of("tokens", tokens).alias("items"), F.coalesce(F.col("verdict") == "block", F.lit(False)).alias("blocked")).where(F.size("items") > 1)
    n = baskets.count()
    found: dict[frozenset, tuple[int, int]] = {}
    for chosen in choices(baskets, tokens, longest):
        own = _of("items", chosen)
        marked = baskets.select(F.when(F.col("blocked"), F.array_append(own, F.lit(BLOCKED))).otherwise(own).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(need - 0.5) / max(n, need)).fit(marked)
        frequent = {frozenset(r.items): r.freq for r in model.freqItemsets.where(F.size("items") <= longest + 1).collect()}
        for x, pages in frequent.items():
            if BLOCKED not in x and 1 < len(x) <= longest and (blocked := frequent.get(x | {BLOCKED}, 0)) >= need:
                found[x] = (blocked, pages)
    least: list[frozenset] = []
    for x in sorted((x for x, (blocked, pages) in found.items() if implies(blocked, pages, confidence)), key=lambda x: (len(x), sorted(x))):
        if not any(y <= x for y in least):
            least.append(x)
    return rules + [[vocabulary.alike[t] for t in sorted(x)] for x in least]


def blocked_by(rules: list[list[list[str]]]) -> Column:
    """Whether some rule has one of each of its parts' tokens among the row's, by an inverted index from token to (rule, part, number of parts)."""
    if not rules:
        return F.lit(False)
    index: dict[str, list] = {}
    for k, rule in enumerate(rules):
        for part, tokens in enumerate(rule):
            for token in tokens:
                index.setdefault(token, []).append({"r": k, "p": part, "n": len(rule)})
    kind = "array<struct<r:int,p:int,n:int>>"
    postings = F.from_json(F.lit(json.dumps(index)), f"map<string,{kind}>")
    hits = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.coalesce(F.element_at(postings, t), F.array().cast(kind)))))
    return F.exists(hits, lambda h: F.size(F.filter(hits, lambda g: g["r"] == h["r"])) == h["n"])


def judge(pages: DataFrame, rules=RULES, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. labels (page_id, label: block or allow) replace the given rules as what is mined from."""
    rule, verdict = fitting(rules)
    parts = split_url(pages.select("page_id", "url")).select("page_id", "host", "path", tokens().alias("tokens"), rule.alias("rule"), verdict.alias("verdict"))
    evidence = parts.select("tokens", "verdict") if labels is None else parts.select("page_id", "tokens").join(labels, "page_id", "left").select("tokens", F.col("label").alias("verdict"))
    mined = mine(evidence, support, confidence)
    own = F.when(blocked_by(mined), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"))
