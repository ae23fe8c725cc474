"""The engine's operators on small fixtures; registered queries against their SQL."""

from __future__ import annotations

import math
import os
import random
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon as L
from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.operators import answers as A
from tidemark.operators import clusters as C
from tidemark.operators import entities as E
from tidemark.operators import fanout as O
from tidemark.operators import italian as I
from tidemark.operators import keywords as K
from tidemark.operators import pulse as P
from tidemark.plans import catalog, pipeline
from tidemark.sources import capture, exports, sinks
from tidemark.streaming import demand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    assert not isinstance(v, Decimal)
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


FAST = ["canonical_records", "keyword_language", "text_language", "intent_vector", "composite_scores", "demand_opportunity_score", "keyword_gaps", "parent_clusters", "entity_extract", "mann_kendall", "theil_sen", "citation_shares", "sibling_heads", "bm25_scores", "keyword_bands", "audit_rows", "italian_forms", "difficulty_scale",
        "corrected_language", "norm_keys", "observed_clicks", "unmatched_queries", "month_unpivot", "stems_of_texts", "entity_gaps", "gap_heads", "top_opportunities", "reanchored_bands", "citation_checklist", "intent_shift", "gap_changes", "dominant_language", "citation_readiness", "demand_states", "fan_out", "gatekeepers"]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(catalog.ORACLES[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == names
    assert got == Counter(tuple(plain(r[at[c]]) for c in names) for r in cur.fetchall())


def corpus(spark, rows):
    """rows: keyword, volume, parent_topic."""
    data = [(k, w, v, p) for k, (w, v, p) in enumerate(rows)]
    return K.language(spark.createDataFrame(data, "kw_idx long, keyword string, volume long, parent_topic string"))


def sequential(rows, overlap):
    """Direct version of the two clustering passes over stem sets: rows of (set, volume, parent)."""
    clusters, where = [], {}
    for k, (_, _, p) in enumerate(rows):
        if p:
            n = next((i for i, c in enumerate(clusters) if c[0] == p), None)
            if n is None:
                n = len(clusters)
                clusters.append([p, []])
            clusters[n][1].append(k)
            where[k] = n
    heads = [max(c[1], key=lambda i: (rows[i][1] or 0, -i)) for c in clusters]
    for k in sorted((k for k in range(len(rows)) if k not in where), key=lambda k: (-(rows[k][1] or 0), k)):
        s = rows[k][0]
        if not s:
            continue
        best, at = 0, -1
        for n, h in enumerate(heads):
            t = rows[h][0]
            o = len(s & t) / max(len(s), len(t)) if t else 0
            if o > best:
                best, at = o, n
        if at >= 0 and best >= overlap:
            where[k] = at
        else:
            where[k] = len(heads)
            heads.append(k)
    return where


@pytest.mark.parametrize("seed", [1, 2])
def test_leader_clusters_equal_sequential(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{c}q" for c in "abcdefghij"]
    rows = [(" ".join(rnd.sample(words, rnd.randint(0 if k % 9 == 0 else 1, 4))) or "of", rnd.choice([None, 5, 10, 20]), rnd.choice(["t1", "t2", None, None, None])) for k in range(70)]
    df = corpus(spark, rows)
    sets = {r.kw_idx: frozenset(r.s) for r in df.select("kw_idx", X.stems(F.col("keyword"), F.col("language")).alias("s")).collect()}
    want = sequential([(sets[k], v, p) for k, (_, v, p) in enumerate(rows)], 0.6)
    _, membership = C.leader_clusters(df)
    assert {r.kw_idx: r.cluster_index for r in membership.collect()} == want


def test_text_functions(spark):
    rows = [("  Perché  NO ", "1,234.5%", "$1,200", "12%", "https://www.Example-Shoes.com/trail"), ("", "x", None, "", "sub.shop.org")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    got = df.select(X.normalize_keyword(F.col("a"), True), X.coerce_int(F.col("b")), X.coerce_float(F.col("c")), X.coerce_float(F.col("d")), X.domain(F.col("e")), X.same_site(X.domain(F.col("e")), "shop.org")).collect()
    assert tuple(got[0]) == ("perché no", 12345, 1200.0, 0.12, "example-shoes.com", False)
    assert tuple(got[1]) == ("", None, None, None, "sub.shop.org", True)
    stems = spark.createDataFrame([("parties shoes running best car",)], "k string").select(X.stems(F.col("k"), F.lit("en"))).first()[0]
    assert stems == ["party", "sho", "runn", "best", "car"]


def test_difficulty_scale(spark):
    for column, want in (([".08", "0.45", "0.5", "0.9", "1.0"], [8, 45, 50, 90, 100]), (["8", "45", "50"], [8, 45, 50]), (["0", "1", "1", "0"], [0, 100, 100, 0]), (["45.5", "120", "x"], [46, 100, None])):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(column)], "k int, v string").withColumn("d", X.coerce_difficulty(F.col("v")))
        top = df.agg(F.max("d")).first()[0]
        assert [r[0] for r in df.orderBy("k").select(X.scaled_difficulty(F.col("d"), F.lit(top))).collect()] == want


def test_extract_fixture(spark):
    df = corpus(spark, [("running shoes", 1, None), ("trail running shoes", 1, None), ("best shoes", 1, None)])
    got = {r.term: r for r in E.extract(df).collect()}
    assert set(got) == {"running", "shoes", "running shoes"} and got["shoes"].df == 3 and got["shoes"].idf == 0


def test_trends(spark):
    series = [("up", k, 1.0 + k) for k in range(12)] + [("flat", k, 100.0) for k in range(12)] + [("two", k, float(k)) for k in range(2)] + [("line", k, 2.0 * k + 5) for k in range(9)]
    df = spark.createDataFrame(series, "grp string, pos long, v double")
    mk = {r.grp: r for r in P.mann_kendall(df).collect()}
    assert mk["up"].direction == "up" and mk["up"].tau == 1 and mk["up"].p_value < 0.05
    assert mk["flat"].s == 0 and mk["flat"].p_value is None and mk["two"].p_value is None
    ts = {r.grp: r for r in P.theil_sen(df).collect()}
    assert (ts["line"].slope, ts["line"].intercept) == (2, 5)
    assert {r.grp: r.state for r in P.states(df).collect()} == {"up": "rising", "flat": "flat", "two": "unknown", "line": "rising"}


def test_seasonal_strength(spark):
    """Made series: a pure cycle on a line, noise alone, a cycle with outliers, and series too short for it."""
    rnd = random.Random(1)
    cycle = [5 * math.sin(math.pi * k / 6) + 3 * (k % 12 == 2) for k in range(72)]
    made = {"cycle": [10 + 0.1 * k + c for k, c in enumerate(cycle)], "noise": [10 + rnd.gauss(0, 1) for _ in range(72)], "outliers": [10 + c + (60 if k in (20, 45) else 0) + rnd.gauss(0, 0.3) for k, c in enumerate(cycle)], "short": cycle[:23], "constant": [4.0] * 30}
    df = spark.createDataFrame([(g, k, float(v)) for g, y in made.items() for k, v in enumerate(y)], "grp string, pos long, v double")
    got = {r.grp: r for r in P.seasonal_strength(df).collect()}
    assert set(got) == {"cycle", "noise", "outliers", "constant"}
    assert got["cycle"].seasonal_strength > 0.99 and got["noise"].seasonal_strength < 0.75 and got["constant"].seasonal_strength == 0
    seasonal, trend, rest = P.decompose(np.array(made["cycle"]))
    assert np.abs(seasonal + trend + rest - made["cycle"]).max() < 1e-9 and np.abs(seasonal - cycle + np.mean(cycle[:12])).max() < 0.3
    seasonal, _, rest = P.decompose(np.array(made["outliers"]))
    assert {*np.argsort(-np.abs(rest))[:2]} == {20, 45} and np.abs(seasonal - cycle + np.mean(cycle[:12])).max() < 1.5  # outliers stay out of the cycle
    state = {r.grp: r.state for r in P.states(df, P.seasonal_strength(df)).collect()}
    assert state["cycle"] == "seasonal" and state["constant"] == "flat"


def test_loess_fits_lines_and_follows_weights():
    y = 3.0 + 2.0 * np.arange(20)
    assert P._loess(y, np.array([-1.0, 0.0, 7.5, 20.0]), 7, np.ones(20)) == pytest.approx([1, 3, 18, 43])
    bent = y.copy()
    bent[10] = 500
    weights = np.ones(20)
    weights[10] = 0
    assert P._loess(bent, np.array([10.0]), 7, weights) == pytest.approx([23])


def test_checklist_and_run_changes(spark):
    rows = [(0, "what are shoes", 100, None, ["paa"]), (1, "red shoes", 50, 3, ["shopping", "paa"]), (2, "boots", 10, None, [])]
    df = spark.createDataFrame([(*r, "question" if r[0] == 0 else "neither", r[0] == 0) for r in rows], "kw_idx long, keyword string, volume long, position int, serp_features array<string>, question_paa string, question_shape boolean")
    membership = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "kw_idx long, cluster_index long")
    spread = spark.createDataFrame([("shoes", 0), ("red", 0)], "term string, dominant_cluster long")
    gaps = spark.createDataFrame([("shoes", 5, 0)], "term string, demand_volume long, suggested_cluster long")
    fan = spark.createDataFrame([(0, ["why"], ["recent"]), (1, [], ["recent", "implicit"])], "cluster_index long, gatekeepers array<string>, missing array<string>")
    state = spark.createDataFrame([(0, "rising"), (1, "unknown")], "cluster_index long, state string")
    got = {(r.cluster_index, r.component): r for r in A.checklist(df, membership, spread, gaps, fan, state).collect()}
    assert len(got) == 12
    assert [got[0, c].examples for c in ("extractability", "entity_coverage", "structured_signals", "information_gain")] == ["red shoes|what are shoes", "shoes", "paa|shopping", "why"]
    assert [got[1, c].examples for c in ("extractability", "entity_coverage", "structured_signals", "information_gain")] == ["", "", "", "implicit|recent"]
    assert got[0, "freshness_proxy"].basis.endswith(": rising") and "unknown" in got[1, "freshness_proxy"].basis


def test_hot_stems_pair_only_plain_sets(spark):
    """A stem that all sets hold: the prefix filter gives the same pairs as comparing all, without a join on that stem alone."""
    rnd = random.Random(3)
    sets = sorted({tuple(sorted({"hot", *rnd.sample([f"w{k}" for k in range(30)], rnd.randint(0, 4))})) for _ in range(150)})
    df = spark.createDataFrame([(list(s),) for s in sets], "set array<string>")
    got = {(tuple(r.s), tuple(r.h)): r.overlap for r in C._candidates(df, df, 0.6).collect()}
    share = lambda a, b: len({*a} & {*b}) / max(len(a), len(b))
    assert got == {(a, b): share(a, b) for a in sets for b in sets if share(a, b) >= 0.6}


@pytest.mark.parametrize(("hot", "many"), [(200, 8), (2, 8), (2, 1)])
def test_siblings_equal_brute_force(spark, monkeypatch, hot, many):
    """Paired by shared tokens, by sets of hot tokens, or (heads of many hot ones) by each hot token: the same siblings."""
    monkeypatch.setattr(O, "MANY", many)
    rnd = random.Random(5)
    words = [f"w{c}" for c in "abcdefghijkl"]
    heads = [" ".join(rnd.choices(words, [40, 20, 10, 8, 5, 4, 3, 2, 1, 1, 1, 1], k=rnd.randint(1, 4))) for _ in range(70)] + ["", "?", None]
    df = spark.createDataFrame(list(enumerate(heads)), "cluster_index long, head string")
    got = {(r.cluster_index, r["rank"]): (r.sibling, round(r.jaccard, 9)) for r in O.siblings(df, hot=hot).collect()}
    sets = [set((h or "").split()) - {"?"} for h in heads]
    want = {}
    for a, s in enumerate(sets):
        near = sorted((-len(s & t) / len(s | t), heads[b], b) for b, t in enumerate(sets) if s & t and s != t)[:3]
        want |= {(a, k): (h, round(-j, 9)) for k, (j, h, _) in enumerate(near, 1)}
    assert got == want


def test_numbers_follow_the_order(spark):
    at = random.Random(1).sample(range(1000), 60)
    df = C.settle(spark.createDataFrame([(x,) for x in at], "at long"))
    for found in (C.numbered(df, "at", "n", bits=4), C.numbered_by_range(df, "at", "n")):
        assert sorted((r.n, r.at) for r in found.collect()) == list(enumerate(sorted(at)))


def test_bm25_and_coverage(spark):
    docs = spark.createDataFrame([(0, 0, "running shoes"), (0, 1, "trail shoes"), (0, 2, "dog food")], "cluster_index long, kw_idx long, keyword string")
    q = spark.createDataFrame([(0, "shoes", "shoes", "related"), (0, "dog", "dog", "implicit"), (0, "cat", "cat", "recent")], "cluster_index long, query string, norm string, archetype string")
    scored = {(r.query, r.doc): r.score for r in O.bm25(q, docs).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert scored["shoes", 0] == pytest.approx(idf * 2.2 / 2.2)
    by_query, by_cluster = O.coverage(q, O.bm25(q, docs))
    assert {r.query: r.covered for r in by_query.collect()} == {"shoes": True, "dog": True, "cat": False}
    (c,) = by_cluster.collect()
    assert c.missing == "recent" and c.coverage == 0.6667


def test_sub_queries(spark):
    heads = spark.createDataFrame([(0, "best shoes"), (1, "best boots")], "cluster_index long, head string")
    docs = spark.createDataFrame([(0, 0, "best shoes"), (0, 1, "red shoes"), (1, 2, "best boots")], "cluster_index long, kw_idx long, keyword string")
    got = [r for r in O.sub_queries(heads, docs, year=2026).orderBy("cluster_index", "rank").collect() if r.cluster_index == 0]
    assert [r.text for r in got[:5]] == ["best shoes red", "what best shoes", "best shoes vs best boots", "best shoes 2026", "top shoes"]
    assert len({r.norm for r in got}) == len(got) <= 12


def test_click_bands(spark):
    rows = [(0, 0, 1000, 1, []), (1, 0, 1000, None, ["ai_overview"]), (2, 0, 0, 5, []), (3, 0, 1000, 8, ["featured_snippet", "shopping"])]
    df = spark.createDataFrame(rows, "kw_idx long, cluster_index long, volume long, position int, serp_features array<string>")
    got = {r.kw_idx: r for r in A.keyword_bands(df).collect()}
    assert set(got) == {0, 1, 3} and got[0].high == 0
    assert got[1].high == pytest.approx(285 * 0.39 * 1.25) and got[3].current == pytest.approx(1000 * 0.03818 * 0.4807)
    (c,) = A.cluster_bands(A.keyword_bands(df)).collect()
    assert c.winnable_low <= c.winnable_high and c.ceiling_high >= c.current_clicks
    assert [N.ctr(F.lit(r)) is not None for r in (1, 20, 99)] == [True] * 3


def test_language_correction(spark):
    rows = [("prezzo scarpe", "en", 0.4), ("scarpe running roma", "en", 0.4), ("what is this", "en", 0.95)] + [(f"offerta {k}", "en", 0.4) for k in range(12)] + [("cooperazione mento", "en", 0.4)]
    df = spark.createDataFrame([(*r, "informational", []) for r in rows], "keyword string, language string, language_confidence double, query_type string, serp_features array<string>")
    got = {r.keyword: r for r in I.correct(df).collect()}
    assert got["prezzo scarpe"].language == "it" and got["prezzo scarpe"].query_type == "transactional" and got["what is this"].language == "en"
    assert got["scarpe running roma"].language == "en"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Keyword,Volume,KD,Traffic Potential (TP),Current position,SERP features\n\"best, shoes\",\"1,200\",20,5,4,\"People Also Ask, Odd\"\nCAFÉ bar,300,50,1,,\n,1,2,3,4,\n".encode())
    (tmp_path / "b.csv").write_bytes("Top queries;Clicks;Impressions;CTR;Position\nbest shoes;5;100;6.7%;3.2\n".encode("iso-8859-1"))
    (tmp_path / "s.csv").write_text("keyword,2025-02,2025-01\nbest shoes,2,\nbest shoes,3,1\n")
    return tmp_path


def test_exports(spark, files):
    df = exports.read_exports(spark, [files / "a.csv", files / "b.csv"])
    got = [tuple(r) for r in df.orderBy("kw_idx").select("kw_idx", "keyword", "source", "source_row", "volume", "difficulty", "position", "serp_features", "ctr").collect()]
    assert got == [(0, "best, shoes", "ahrefs", 2, 1200, 20, 4, ["paa", "_unknown_odd"], None), (1, "café bar", "ahrefs", 3, 300, 50, None, [], None), (2, "best shoes", "gsc", 2, None, None, 32, [], 0.067)]
    series = {(r.norm_kw, r.period): r.value for r in exports.read_series(spark, files / "s.csv").collect()}
    assert series == {("best shoes", "2025-01"): 1.0, ("best shoes", "2025-02"): 3.0}
    with pytest.raises(exports.SourceError):
        exports.expand([files / "none.csv"])
    assert exports.fingerprint([files / "a.csv", files / "b.csv"]) == exports.fingerprint([files / "b.csv", files / "a.csv"])
    assert {r.field for r in exports.show_mapping(spark, [files / "b.csv"]).collect()} == {"keyword", "clicks", "impressions", "ctr", "position"}


def test_pipeline_and_sinks(spark, files, tmp_path):
    run = pipeline.from_exports(spark, [files / "a.csv", files / "b.csv"], modules=("entity_web", "fan_out_radar", "demand_pulse", "citation_grid", "click_ceiling"), series_path=str(files / "s.csv"))
    (s,) = run.summary().collect()
    assert s.total_keywords == 3 and 0 <= s.demand_opportunity_score <= 100
    assert run.slots["bands"].count() >= 1 and run.slots["readiness"].count() == run.clusters.count()
    sinks.write_csv(run.keywords.select("kw_idx", "keyword", "serp_features", "question_shape", "score_main"), str(tmp_path / "out.csv"))
    lines = (tmp_path / "out.csv").read_bytes().decode("utf-8-sig").split("\r\n")
    assert lines[0].startswith("kw_idx,keyword") and len(lines) == 5
    page = sinks.dashboard("<t>", {"clusters": run.clusters}, {"sizes": [("<a>", 2.0)]})
    assert "&lt;t&gt;" in page and "<a>" not in page
    state = sinks.run_state({"n": 1.23456789}, {"click_ceiling": {"x": 1}}, "2026-01-01T00:00:00Z")
    sinks.save_state(state, str(tmp_path / "run.json"))
    assert sinks.load_state(str(tmp_path / "run.json"))["engine"]["n"] == 1.234568
    assert pipeline.compare(run, run)["added"].count() == 0


def test_capture(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"livewire_capture": {"client_domain": "example.com", "search_console": {"rows": [{"query": "Best Shoes", "clicks": 5, "impressions": "100", "ctr": "5.4%", "position": 3.5}]}, "ai_citations": {"rows": [{"query": "q", "surface": "s", "citations": [{"domain": "https://www.shop.example.com/x"}, {"domain": "b.org"}]}]}}}')
    got = capture.load(spark, str(tmp_path / "c.json"))
    (r,) = capture.search_rows(got).collect()
    assert tuple(r)[:4] == ("Best Shoes", "best shoes", 5, 100) and r.ctr == pytest.approx(0.054) and r.position == 3.5
    assert {(r.domain, r.is_client) for r in capture.citations(got).collect()} == {("shop.example.com", True), ("b.org", False)}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", "2025-01-01 00:00:00", 2.0), ("a", "2025-01-02 00:00:00", 3.0)], "k string, t string, v double").select("k", F.col("t").cast("timestamp").alias("ts"), "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = demand.demand(stream, "k", "v").writeStream.outputMode("complete").format("memory").queryName("d").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.demand for r in spark.sql("select * from d").collect()] == [5.0]


@pytest.mark.parametrize("name", ["cluster_bands", "cluster_view", "question_examples", "authority_order", "citation_checklist"])
def test_modules_read_the_stored_corpus(spark, name):
    """The corpus is computed once and stored: no branch of the final plan goes back to the given tables."""
    files = catalog.QUERIES[name](spark, SF).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "part.parquet" in f]


def test_keywords_are_dealt_over_all_partitions(spark):
    """Few bytes of keywords are much work; one small file must not become one task."""
    from tidemark.plans import bindings as B

    assert B.keywords(spark, SF).rdd.getNumPartitions() == 4


def test_keywords_stay_dealt_after_a_shuffled_join(spark):
    """A shuffle by the join's own key would be left out, and the join's partitions merged into one."""
    from tidemark.plans import bindings as B

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert B.keywords(spark, SF).rdd.getNumPartitions() == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_terms_mark_first_occurrences(spark):
    """All n-grams of adjacent words that are no stop words, against plain Python; repeated ones are new once."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["red", "bolt", "the", "x", "rod", "a"], k=rng.randrange(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "kw_idx long, keyword string, language string")
    want = Counter()
    for k, t in enumerate(texts):
        words = [w for w in t.split() if len(w) >= 2]
        seen = {}
        for n in (1, 2, 3):
            for i in range(len(words) - n + 1):
                if not set(words[i : i + n]) & set(L.ENTITY_STOPS["en"]):
                    seen.setdefault(" ".join(words[i : i + n]), []).append(i)
        want.update((k, term, i, j == 0) for term, at in seen.items() for j, i in enumerate(at))
    got = Counter(tuple(r) for r in E.terms(E.with_terms(df, 3), "kw_idx").select("kw_idx", "term", "first", "new").collect())
    assert got == want and any(not new for _, _, _, new in got)


def test_modules_read_stored_terms(spark):
    """Terms are much work: no module's plan splits keywords again, and only counts of terms are shuffled."""
    from tidemark.plans import modules as M

    df, entities = M._entities(spark, SF)
    membership = C.parent_clusters(df)[1]
    for made in (E.authority(df, entities, membership), E.spread(df, entities, membership), E.graph(df, entities), E.extract(df)):
        assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_made_once_where_they_are_not_stored(spark):
    """No filter inferred of the explode holds a copy of what makes the terms, rows without terms still count, and extract stores them."""
    df = spark.createDataFrame([(1, "red bolt", "en"), (2, "red rod", "en"), (3, "the", "en"), (4, None, "en")], "kw_idx long, keyword string, language string")
    loose = E.terms(E.with_terms(df), "kw_idx")
    assert loose._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 1
    assert Counter(r.kw_idx for r in loose.collect()) == {1: 3, 2: 3}
    got = E.extract(df)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.term, r.tf, r.df, r.idf) for r in got.collect()] == [("red", 2, 2, round(math.log(4 / 2), 6))]


def test_stored_rows_are_not_gathered_on_the_driver(spark):
    """Two million rows of a stored table, few bytes when compressed, are no broadcast, also where few of its columns are read."""
    wide = C.settle(spark.range(2_000_000).select(F.col("id").alias("kw_idx"), F.lit("a keyword").alias("keyword"), *((F.col("id") % 2).alias(f"c{k}") for k in range(8))))
    other = C.settle(spark.range(3_000_000).select(F.col("id").alias("kw_idx"), (F.col("id") % 7).alias("cluster_index")))
    joined = other.join(wide.select("kw_idx", "keyword"), "kw_idx")
    assert joined.count() == 2_000_000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    few = joined.join(C.settle(spark.range(7).select(F.col("id").alias("cluster_index"), F.lit("head").alias("head"))), "cluster_index")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.sources.fileCompressionFactor", "250.0")
    C.settle(spark.range(1))
    assert spark.conf.get("spark.sql.sources.fileCompressionFactor") == "250.0"  # a larger factor stays
    spark.conf.unset("spark.sql.sources.fileCompressionFactor")


def test_documents_of_bm25_are_stored(spark):
    """Three branches of BM25 read them; none joins members and keywords again."""
    from tidemark.plans import modules as M

    assert "Join" not in M._implicit(spark, SF)[1]._jdf.queryExecution().optimizedPlan().toString()


def test_scores_halfway_between_tenths_round_up(spark):
    """Quick-win scores by exact arithmetic, for every difficulty and rank, with volumes whose logarithm is whole: many lie exactly halfway."""
    from decimal import ROUND_HALF_UP

    rows = [(100 * d + p, v, d, p) for v in (100, 1000) for d in range(36) for p in range(4, 31)]
    df = spark.createDataFrame([(k + v * 10_000, v, d, p, "informational", [], "gsc", 0.65, 0.4, True, False, 0, 0, "quick_win", "not_striking") for k, v, d, p in rows],
        "kw_idx long, volume long, difficulty int, position int, query_type string, serp_features array<string>, source string, language_confidence double, intent_confidence double, clustered boolean, branded boolean, geo_score int, aio_score int, quick_win string, striking string")
    halfway = 0
    for r in K.scores(df).select("volume", "difficulty", "position", "score_quick_win").collect():
        p = r.position
        place = Decimal(80 - (p - 4) * 5) if p <= 10 else Decimal(50 - (p - 11) * 3) if p <= 20 else max(Decimal(5), 25 - Decimal(p - 21) / 2)
        exact = (30 * Decimal(100 - r.difficulty) + 25 * Decimal(40 if r.volume == 100 else 60) + 15 * place + 15 * Decimal(L.INTENT_SCORE["quick_win"]["informational"]) + 600 + 250) / 100
        halfway += exact * 10 % 1 == Decimal("0.5")
        assert Decimal(str(r.score_quick_win)) == exact.quantize(Decimal("0.1"), ROUND_HALF_UP), r
    assert halfway > 100
