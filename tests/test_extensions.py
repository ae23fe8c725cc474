"""Graph measures, reconciliation, subclusters and cannibalisation on small cases, against plain computations."""

from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import pytest

from tidemark.operators import cannibal as N
from tidemark.operators import graphs as G
from tidemark.operators import reconcile as V
from tidemark.operators import subclusters as U


def test_ranks_and_cores_of_a_planted_graph(spark):
    rnd = random.Random(4)
    edges = {(f"c{i}", f"c{j}"): 1 for i in range(6) for j in range(i)}  # a clique of six, a ring, loose ends
    edges |= {(f"r{k}", f"r{(k + 1) % 20}"): 2 for k in range(20)} | {("r0", "c0"): 3} | {("c1", f"leaf{k}"): 1 for k in range(8)}
    edges |= {(f"x{i}", f"x{j}"): rnd.randint(1, 5) for i in range(15) for j in range(i) if rnd.random() < 0.4}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    df = spark.createDataFrame([*rows, ("c0", "c0", 9), ("z", "c0", 0)], "a string, b string, weight long")
    near = defaultdict(Counter)
    for a, b, w in rows:
        near[a][b] += w
        near[b][a] += w
    rank = dict.fromkeys(near, 1 / len(near))
    for _ in range(60):
        rank = {v: 0.15 / len(near) + 0.85 * sum(rank[u] * near[u][v] / sum(near[u].values()) for u in near[v]) for v in near}
    got = {r.term: r.rank for r in G.pagerank(df).collect()}
    assert got == pytest.approx(rank, abs=1e-12) and sum(got.values()) == pytest.approx(1)
    core, left, k = {}, {v: set(u) for v, u in near.items()}, 0
    while left:  # peeling
        k = max(k, min(map(len, left.values())))
        for v in [v for v, u in left.items() if len(u) <= k]:
            core[v] = k
            for u in left.pop(v, ()):
                left.get(u, set()).discard(v)
    assert {r.term: r.core for r in G.cores(df).collect()} == core and core["c3"] == 5
    none = spark.createDataFrame([], df.schema)
    assert G.pagerank(none).count() == 0 and G.cores(none).count() == 0


def test_reconciled_values(spark):
    rows = [("a", "gsc", 100, 40, None, ["paa"], "Info"), ("a", "moz", 300, None, 12, ["paa", "shopping"], " "), ("a", "moz", 300, 50, 3, [], "buy"), ("b", None, None, None, None, None, None), ("c", "other", 7, 1, 5, [], None), (None, "gsc", 1, 1, 1, [], None)]
    df = spark.createDataFrame(rows, "keyword string, source string, volume long, difficulty int, position int, serp_features array<string>, intent_label_raw string")
    weights = {r.source: r.w for r in df.select("source", V.weight(df.source).alias("w")).distinct().collect()}
    for mode in V.MODES:
        got = {r.keyword: r for r in V.reconcile(df, mode).collect()}
        copies = [100] * weights["gsc"] + [300] * 2 * weights["moz"]
        want = {"median": statistics.median(copies), "mean": round(statistics.mean(copies), 4), "min": 100, "max": 300}[mode]
        assert got["a"].volume == want and got["a"].difficulty == pytest.approx({"median": 40.0, "mean": statistics.mean([40] * weights["gsc"] + [50] * weights["moz"]), "min": 40, "max": 50}[mode], abs=1e-4)
    a, b = got["a"], got["b"]
    assert (a.n_rows, a.n_sources, a.multi_source, a.volume_confidence, a.position, a.serp_features, a.intents) == (3, 2, True, 0.5, 3, "paa|shopping", "Info,buy")
    assert (b.n_rows, b.multi_source, b.volume, b.volume_confidence, b.position, b.serp_features, b.intents) == (1, False, None, None, None, "", "") and None in got
    assert [r.multi_source for r in V.flagged(df).orderBy("keyword", "volume").collect()] == [False, True, True, True, False, False]
    with pytest.raises(ValueError):
        V.reconcile(df, "mode")


def test_subclusters_equal_a_sequential_split(spark):
    rnd = random.Random(9)
    rows = [(k, f"kw{k}", rnd.choice([None, 0, 5, 5, 9, 100]), rnd.choice(["a", "b", None]), "s") for k in range(700)]
    cluster = {k: 0 if k < 300 else rnd.randint(1, 90) for k in range(680)}  # one holds nearly half
    df = spark.createDataFrame(rows, "kw_idx long, keyword string, volume long, query_type string, funnel_stage string")
    membership = spark.createDataFrame(list(cluster.items()), "kw_idx long, cluster_index long")
    found, own = U.split(df, membership, limit=7)
    groups = defaultdict(list)
    for k, c in cluster.items():
        groups[c].append(rows[k])
    want = {}
    for c, members in groups.items():
        parts = {(None, None): members}
        if len(members) > 7:
            parts, by = {}, defaultdict(list)
            for m in members:
                by[f"{m[3] or ''}/{m[4]}"].append(m)
            for intent, ms in by.items():
                ms.sort(key=lambda m: (-(m[2] or 0), m[0]))
                size = -(-len(ms) // -(-len(ms) // 7))
                parts |= {(intent, p): ms[p * size : (p + 1) * size] for p in range(-(-len(ms) // size))}
        for (intent, piece), ms in parts.items():
            head = min(ms, key=lambda m: (-(m[2] or 0), m[0]))
            want[min(m[0] for m in ms)] = (c, intent, piece, head[1], len(ms), sum(m[2] or 0 for m in ms), len(ms) == 1, {m[0] for m in ms})
    members = defaultdict(set)
    for r in own.collect():
        members[r.subcluster].add(r.kw_idx)
    got = {r.subcluster: (*r[1:], members[r.subcluster]) for r in found.collect()}
    assert got == {k: want[at] for k, at in enumerate(sorted(want))} and all(g[4] <= 7 for g in got.values())
    empty = U.split(df, membership.limit(0))
    assert empty[0].count() == empty[1].count() == 0


def test_briefs_list_keywords_as_written(spark):
    from tidemark.operators import summary as S

    rows = [(0, "red shoes", "Red Shoes", 5), (1, "red shoes", "RED shoes", 9), (2, "how to clean shoes", "How to clean shoes?", 3), (3, "plain", None, 1)]
    df = spark.createDataFrame([(*r, r[0] == 2, "create") for r in rows], "kw_idx long, keyword string, keyword_original string, volume long, question_shape boolean, action string")
    clusters = spark.createDataFrame([(0, "red shoes", 4, 18, "informational")], "cluster_index long, head string, size long, volume_total long, dominant_intent string")
    membership = spark.createDataFrame([(k, 0) for k in range(4)], "kw_idx long, cluster_index long")
    got = S.briefs(df, clusters, membership).first()
    assert (got.primary, got.secondaries, got.questions) == ("Red Shoes", "How to clean shoes?|plain", "How to clean shoes?")
    assert S.briefs(df.drop("keyword_original"), clusters, membership).first().primary == "red shoes"


def test_serialised_records_and_orders(spark):
    import json

    from tidemark.operators import compare as R
    from tidemark.operators import entities as E
    from tidemark.sources import reports

    df = spark.createDataFrame([(3, "b", 1.23456789, "p", "u", 1, "raw", ["x"]), (4, None, None, None, None, None, None, None)], "kw_idx long, keyword string, score double, parent_topic string, competitor_url string, domain_rank int, intent_label_raw string, serp_features array<string>")
    got = {r.kw_idx: r.record for r in reports.serialised(df).collect()}
    assert got[3] == '{"keyword":"b","score":1.234568,"serp_features":["x"]}' and json.loads(got[4]) == {}
    weights = spark.createDataFrame([(0, 0.5, 7), (1, 0.1, 9), (2, 0.0, 7), (3, 1.0, 0)], "cluster_index long, authority double, weight long")
    assert [r.cluster_index for r in E.in_order(weights).orderBy("place").collect()] == [1, 0, 2, 3]
    base, current = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in ("abcc", "bxyz"))
    assert sorted(tuple(r) for r in R.samples(R.changes(base, current, "k"), "k", 2).collect()) == [("added", "x", 1), ("added", "y", 2), ("dropped", "a", 1), ("dropped", "c", 2)]


def test_pages_that_compete(spark):
    columns = "keyword string, competitor_url string, position int, source string, branded boolean"
    early = spark.createDataFrame([("x", "https://www.c.example/1", 4, "gsc", False), ("x", "https://rival.example/c.example", 1, "gsc", False), ("y", "https://c.example/1", None, "moz", None), ("brand", "https://c.example/9", 1, "gsc", True)], columns)
    late = spark.createDataFrame([("x", "https://shop.c.example/2", 6, "gsc", False), ("x", "https://www.c.example/1", 3, "moz", False), ("brand", "https://c.example/8", 2, "gsc", True), ("z", None, 3, "gsc", False)], columns)
    found = N.pages([early, late], "c.example")
    risk = {r.keyword: r for r in N.keyword_risk(found).collect()}
    assert set(risk) == {"x", "y"} and (risk["x"].urls, risk["x"].risk, risk["x"].label, risk["x"].confidence) == (2, 97.0, "cannibalized", 0.9)
    assert (risk["y"].risk, risk["y"].label, risk["y"].confidence) == (0.0, "no_risk", 0.6) and risk["x"].evidence == "https://shop.c.example/2|https://www.c.example/1"
    members = spark.createDataFrame([("x", 0), ("y", 0), ("x", 0)], "keyword string, cluster_index long")
    assert [tuple(r) for r in N.cluster_rivals(found, members).collect()] == [(0, "https://www.c.example/1", "https://shop.c.example/2", 3, 97.0)]
    assert {r.keyword for r in N.keyword_risk(N.pages([early, late], "c.example", branded=True)).collect()} == {"x", "y", "brand"}
