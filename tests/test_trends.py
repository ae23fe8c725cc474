"""Rank statistics against all pairs, the normal tail against erf, and trends on streams against batch."""

from __future__ import annotations

import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.operators import pulse as P
from tidemark.operators import ranks as R
from tidemark.streaming import trends as T


def by_pairs(pos, v):
    i, j = np.triu_indices(len(v), 1)
    return int(np.sign(v[j] - v[i]).sum()), float(np.median((v[j] - v[i]) / (pos[j] - pos[i])))


@pytest.mark.parametrize("kind", ["normal", "few values", "cents", "constant", "line", "walk with gaps"])
def test_ranks_equal_all_pairs(kind, monkeypatch):
    monkeypatch.setattr(R, "FEW", 3)
    rng = np.random.default_rng(5)
    for n in [*range(2, 40), 300, 1200]:
        pos = np.cumsum(rng.integers(1, 5, n)) if kind == "walk with gaps" else np.arange(n)
        v = {"normal": rng.normal(size=n), "few values": rng.integers(0, 4, n), "cents": rng.integers(0, 1000, n) / 100, "constant": np.full(n, 7), "line": 3.5 * np.arange(n), "walk with gaps": rng.normal(size=n).cumsum() * 1e6}[kind].astype(float)
        s, slope = by_pairs(pos, v)
        assert R.kendall(v) == s and R.median_slope(pos, v) == pytest.approx(slope, rel=1e-10, abs=1e-10)
    assert R.median_slope(np.arange(1), np.ones(1)) is None and R.kendall(np.ones(1)) == 0 and R.inversions(np.array([], int)) == 0


def test_a_long_series_takes_seconds():
    v = np.random.default_rng(1).normal(size=100_000).cumsum()
    began = time.time()
    R.kendall(v)
    slope = R.median_slope(np.arange(100_000), v)
    assert time.time() - began < 30
    below = R.Slopes(np.arange(100_000.0), v)
    pairs = 100_000 * 99_999 // 2
    assert below.below(slope - 1e-9)[0] <= pairs // 2 <= below.below(slope + 1e-9)[0]


def test_the_normal_tail_is_that_of_erf(spark):
    x = [k / 100 for k in range(-1000, 1001)] + [7.0710678, 7.072, 36.9, 37.1, 50.0, 0.0]
    got = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double").select("x", N.norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p is None if r.x is None else abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-13


def test_trends_of_groups(spark):
    rows = [("a", k, float(v)) for k, v in enumerate([1, 3, 2, 5, 5, 7])] + [("b", 0, 4.0)] + [(None, 0, 1.0), (None, 1, None), (None, 2, 3.0)]
    got = {r.grp: r for r in P.mann_kendall(spark.createDataFrame(rows, "grp string, pos long, v double")).collect()}
    assert (got["a"].n, got["a"].s, got["a"].direction) == (6, 12, "up") and got["a"].p_value == pytest.approx(2 * (1 - 0.5 * math.erfc(-11 / math.sqrt(492 / 18) / math.sqrt(2))), abs=1e-6)
    assert (got["b"].n, got["b"].s, got["b"].z, got["b"].p_value, got["b"].tau) == (1, 0, None, None, None)
    assert got[None].n == 2  # a null value is no point
    assert P.mann_kendall(spark.createDataFrame([], "grp string, pos long, v double")).count() == 0


def test_stream_equals_batch_with_late_rows_and_restarts(spark, tmp_path):
    rng = np.random.default_rng(2)
    start = datetime(2024, 1, 1)
    rows = [("ab"[k % 2], start + timedelta(hours=int(h)), float(v)) for k, (h, v) in enumerate(zip(np.sort(rng.integers(0, 24 * 40, 900)), rng.integers(1, 100, 900), strict=True))]
    rows += [("a", start + timedelta(days=3), None)]
    frame = spark.createDataFrame(rows, "grp string, ts timestamp, value double")
    parts = [frame.where(F.col("ts") < F.lit(start + timedelta(days=20))), frame.where(F.col("ts") >= F.lit(start + timedelta(days=20)))]
    parts.append(spark.createDataFrame([("b", start + timedelta(days=500), 1.0)] + [("a", start + timedelta(days=1), 1e6)] * 3, frame.schema))  # three come too late
    parts.append(spark.createDataFrame([("a", start + timedelta(days=2), 1e6)] * 4, frame.schema))
    own = T.settings(spark.newSession())
    dropped = 0
    for k, part in enumerate(parts):  # each is another start on one checkpoint
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
        stream = own.readStream.schema(frame.schema).parquet(str(tmp_path / "in" / "*"))
        query = T.trends(stream, "grp", "value").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        dropped += T.late_rows(query)
    assert dropped == 7
    got = {r.grp: r for r in sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: r.n)}
    daily = frame.groupBy("grp", F.date_trunc("day", "ts").alias("m")).agg(F.sum("value").alias("v")).where("v is not null")
    series = daily.selectExpr("grp", "row_number() over (partition by grp order by m) - 1 as pos", "v")
    want = {r.grp: r for r in P.states(series).collect()}
    for grp in "ab":
        for c in ("n", "s", "var_s", "z", "p_value", "tau", "slope", "intercept"):
            assert got[grp][c] == pytest.approx(want[grp][c]), (grp, c)
