"""Nearest neighbours against brute force, planted clusters, odd vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import neighbours as M


def planted(groups, each, dim, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c + spread * rng.normal(size=(each, dim)) for c in centres]), np.repeat(np.arange(groups), each)


def test_recall_and_planted_clusters(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 64)  # so that trees are cut several times
    v, group = planted(12, 60, 24, 0.35)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    edges = M.nearest(df, 10)[0].collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosines = unit @ unit.T
    np.fill_diagonal(cosines, -2)
    best = {(i, int(j)) for i in range(len(v)) for j in np.argsort(-cosines[i], kind="stable")[:10]}
    assert len(best & {(e.node, e.other) for e in edges}) >= 0.9 * len(best)
    assert all(abs(e.cosine - cosines[e.node, e.other]) < 1e-12 for e in edges) and max(map(list([e.node for e in edges]).count, range(5))) == 10
    got = {r.id: r.cluster for r in M.embedding_clusters(df).collect()}
    assert len(got) == len(v) and all(len({group[i] for i in got if got[i] == c}) == 1 for c in set(got.values()))  # none mixes two groups
    assert sum(got[i] == min(j for j in got if group[j] == group[i]) for i in got) >= 0.9 * len(v) and all(c <= i for i, c in got.items())
    again = {r.id: r.cluster for r in M.embedding_clusters(df.repartition(7)).collect()}
    assert again == got  # whatever the partitions


def test_odd_vectors_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAF", 20)
    odd = [(1000, None), (1001, []), (1002, [0.0, 0.0]), (1003, [1.0, None]), (1004, [float("nan"), 1.0]), (1005, [float("inf"), 1.0]), (1006, [1.0]), (1007, [1e300, 1e-300]), (1008, [1e-310, 0.0])]
    rows = [(k, [3.0, 4.0]) for k in range(300)] + [(400 + k, [3.0 + k * 1e-9, 4.0]) for k in range(100)] + odd  # hundreds of copies, and more that no plane parts
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {r.id: r.cluster for r in M.embedding_clusters(df, k=5).collect()}
    assert len(got) == len(rows) and all(got[k] == 0 for k in range(300)) and all(got[i] == i for i, _ in odd[:7])
    assert len({got[400 + k] for k in range(100)}) < 30
    assert M.embedding_clusters(df.limit(0)).count() == 0
    assert M.propagate(spark.createDataFrame([], "node long, other long, cosine double")).where(F.col("node") > 0).count() == 0
