"""Statistical keyphrases against a plain computation."""

from __future__ import annotations

import math
import re
import statistics
from collections import Counter, defaultdict

import pytest

from tidemark.functions import lexicon as L
from tidemark.operators import entities as E
from tidemark.operators import keyphrases as K

TEXTS = [
    (1, "en", "Solar Panels cost less. The solar panel market grows! NASA tests solar panels.\nPanels solar everywhere"),
    (2, "en", "A cheap solar panel for NASA? Wind turbines beat the solar market. wind turbine"),
    (3, "de", "Die Sonne und der Wind. Windkraft ist der Markt der Zukunft"),
    (4, None, "the solar market and die Sonne"),
    (5, "en", None), (6, "en", ""), (7, "en", "... !? \n"), (1, "en", "NASA again"),
]


def plain(rows, min_df=2, max_ngram=2):
    every = {w for ws in L.ENTITY_STOPS.values() for w in ws}
    parts = []
    for doc, lang, text in rows:
        for k, s in enumerate(re.findall(r"[^.!?\n]+", text or "")):
            raw = [t for t in re.findall(r"\w+", s) if len(t) >= 2]
            if raw:
                parts.append((doc, k, raw, [t.lower() for t in raw], set(L.ENTITY_STOPS.get(lang, every)) if lang else every))
    tf, capital, acronym, spread, at, left, right = Counter(), Counter(), Counter(), Counter(), defaultdict(list), defaultdict(list), defaultdict(list)
    grams = defaultdict(list)
    for doc, k, raw, t, stop in parts:
        for i, w in enumerate(t):
            if w in stop:
                continue
            tf[w] += 1
            capital[w] += i > 0 and raw[i][0] != raw[i][0].lower()
            acronym[w] += raw[i] == raw[i].upper() != raw[i].lower()
            spread[w] += t.index(w) == i
            at[w].append(k)
            left[w] += t[i - 1 : i] if i else []
            right[w] += t[i + 1 : i + 2]
            for n in range(1, max_ngram + 1):
                if i + n <= len(t) and not any(x in stop for x in t[i : i + n]):
                    grams[" ".join(t[i : i + n])].append((doc, k))
    usual, most = statistics.mean(tf.values()) + statistics.pstdev(tf.values()), max(tf.values())
    s = {}
    for w, n in tf.items():
        related = 1 + sum(len(set(x)) / len(x) for x in (left[w], right[w]) if x) * n / most
        s[w] = related * math.log(math.log(3 + statistics.median(at[w]))) / (max(capital[w], acronym[w]) / (1 + math.log(n)) + (n / usual + spread[w] / len(parts)) / related)
    out = {}
    for g, where in grams.items():
        if len({d for d, _ in where}) >= min_df:
            own = [s[w] for w in g.split()]
            score = math.log(len(where)) + math.log(1 + sum(own)) - sum(map(math.log, own))
            key = " ".join(sorted({w[:-1] if len(w) > 3 and w.endswith("s") else w for w in g.split()}))
            out.setdefault(key, []).append((-round(score, 6), g, len(where), len({d for d, _ in where})))
    return {g: (n, d, -s) for s, g, n, d in map(min, out.values())}


def test_keyphrases_equal_the_plain_computation(spark):
    df = spark.createDataFrame([(d, t, lang, 1) for d, lang, t in TEXTS], "kw_idx long, keyword string, language string, term int").drop("term")
    got = {r.term: (r.tf, r.df, pytest.approx(r.score, abs=2e-6)) for r in E.extractor("statistical")(df).collect()}
    want = plain(TEXTS)
    assert got == want
    assert len([t for t in got if {w.rstrip("s") for w in t.split()} == {"solar", "panel"}]) == 1  # near-duplicates are merged
    assert K.keyphrases(spark.createDataFrame([], "kw_idx long, keyword string, language string")).count() == 0


def test_salient_takes_either_extractor(spark):
    df = spark.createDataFrame([(k, t, "en", 10 * k, 3 if k % 2 else None) for k, t in enumerate(["solar panel cost", "solar panel price", "wind turbine cost", "wind turbine"])], "kw_idx long, keyword string, language string, volume long, position int")
    for by in ("ngram", "statistical"):
        rows = E.salient(df, by=by).orderBy("rank").collect()
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and {"solar", "wind"} <= {r.term for r in rows}
    with pytest.raises(ValueError):
        E.salient(df, by="none")


def test_no_shuffle_of_every_occurrence(spark):
    """Phrases are not grouped by row and sentence at once, which leaves nearly every occurrence to be shuffled."""
    df = spark.createDataFrame(TEXTS, "kw_idx long, language string, keyword string")
    plan = K.keyphrases(df)._jdf.queryExecution().toString()
    assert "Aggregate [term#" in plan and not re.search(r"Aggregate \[term#\d+, kw_idx#\d+L?, sentence#", plan)


def test_words_are_made_once_and_by_place(spark):
    """No filter inferred of an explode makes phrases again, and no word looks through its sentence, however long that is."""
    rows = [(k, "en", " ".join(f"{'wW'[i % 2]}{(7 * i + k) % 503}" for i in range(4_000)) + ". the end") for k in range(3)]
    found = K.keyphrases(spark.createDataFrame(rows, "kw_idx long, language string, keyword string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter .*lambdafunction", plan) and "array_position(" not in plan
    assert {r.term: (r.tf, r.df, pytest.approx(r.score, abs=2e-6)) for r in found.collect()} == plain(rows)
