"""Demand trends: Mann-Kendall, Theil-Sen, momentum and state by group, over (grp, pos, v) with dense positions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import norm_tail
from . import ranks

MIN_POINTS, ALPHA, MOMENTUM_WINDOW = 8, 0.05, 3
PERIOD, SEASONAL_STRENGTH = 12, 0.5


def cluster_series(series: DataFrame, membership: DataFrame) -> DataFrame:
    """(grp, pos, v): sums of members' values by period; periods without a value go. series: kw_idx, period, value."""
    summed = series.where("value is not null").join(membership, "kw_idx").groupBy(F.col("cluster_index").alias("grp"), "period").agg(F.sum("value").alias("v"))
    return summed.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("period")) - 1).cast("long").alias("pos"), "v")


def trends(series: DataFrame) -> DataFrame:
    """grp, n, s, ties, slope, intercept of each group's points, in one grouped pass of O(n log n).

    s: rising less falling pairs; ties: the sum of t (t - 1) (2 t + 5) over runs of equal values; slope: the median pairwise
    slope, 0 for one point; intercept: the median of v - slope * pos. Null values are no points. A group is one series, as
    long as the calendar.
    """
    kind = series.schema["grp"].dataType.simpleString()

    def fit(key, rows):
        rows = rows.sort_values("pos")
        pos, v = rows["pos"].to_numpy(np.int64), rows["v"].to_numpy(float)
        t = np.unique(v, return_counts=True)[1].astype(object)  # exact for any length
        slope = ranks.median_slope(pos, v) or 0.0
        return pd.DataFrame({"grp": [key[0]], "n": [len(v)], "s": [ranks.kendall(v)], "ties": [int((t * (t - 1) * (2 * t + 5)).sum())], "slope": [slope], "intercept": [float(np.median(v - slope * pos))]})

    points = series.select("grp", "pos", F.col("v").cast("double").alias("v")).where("v is not null")
    return points.groupBy("grp").applyInPandas(fit, f"grp {kind}, n long, s long, ties long, slope double, intercept double")


def tested(found: DataFrame) -> DataFrame:
    """found (see trends) with var_s, z, p_value (null when there are fewer than 3 points or no variance) and tau."""
    few = F.col("n") < 3
    found = found.withColumns({"s": F.when(few, 0).otherwise(F.col("s")), "var_s": F.when(few, 0.0).otherwise(F.expr("(n * (n - 1) * (2 * n + 5) - ties) / 18"))})
    z = F.when(F.col("var_s") <= 0, None).when(F.col("s") > 0, (F.col("s") - 1) / F.sqrt("var_s")).when(F.col("s") < 0, (F.col("s") + 1) / F.sqrt("var_s")).otherwise(0.0)
    found = found.withColumn("z", z)
    return found.withColumns({"p_value": F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * norm_tail(F.abs("z")))), "tau": F.when(~few, F.col("s") / (F.col("n") * (F.col("n") - 1) / 2))})


def _test_columns() -> list:
    direction = F.when(F.col("s") > 0, "up").when(F.col("s") < 0, "down").otherwise("flat")
    return ["grp", "n", "s", *(F.round(c, 6).alias(c) for c in ("var_s", "z", "p_value", "tau")), direction.alias("direction")]


def mann_kendall(series: DataFrame) -> DataFrame:
    """grp, n, s, var_s, z, p_value, tau, direction; p null when there are fewer than 3 points or no variance."""
    return tested(trends(series)).select(_test_columns())


def theil_sen(series: DataFrame) -> DataFrame:
    """grp, slope, intercept: median pairwise slope; median of v - slope * pos with the unrounded slope."""
    return trends(series).select("grp", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


def momentum(series: DataFrame, window: int = MOMENTUM_WINDOW) -> DataFrame:
    """grp, momentum: mean of the last points over the mean of those before, less 1; null without enough points."""
    back = series.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("pos").desc())))
    got = back.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.when(F.col("r") <= window, F.col("v"))).alias("l"), F.avg(F.when(F.col("r").between(window + 1, 2 * window), F.col("v"))).alias("p"))
    return got.select("grp", F.when((F.col("n") >= 2 * window) & (F.col("p") != 0), F.round(F.col("l") / F.col("p") - 1, 6)).alias("momentum"))


def states(series: DataFrame, seasonal: DataFrame | None = None) -> DataFrame:
    """grp, state and the tests behind it; with seasonal (see seasonal_strength) a strong cycle makes the state `seasonal`."""
    tests = tested(trends(series)).select(*_test_columns(), F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))
    all_ = tests.join(momentum(series), "grp")
    all_ = all_.join(seasonal.select("grp", "seasonal_strength"), "grp", "left") if seasonal is not None else all_.withColumn("seasonal_strength", F.lit(None).cast("double"))
    firm = F.coalesce(F.col("p_value") < ALPHA, F.lit(False))
    state = F.when(F.col("n") < MIN_POINTS, "unknown").when(F.col("seasonal_strength") >= SEASONAL_STRENGTH, "seasonal").when(firm & (F.col("slope") > 0), "rising").when(firm & (F.col("slope") < 0), "declining").otherwise("flat")
    return all_.withColumn("state", state)


def state_counts(found: DataFrame) -> DataFrame:
    """(state, n, with_series): groups in each state, and how many of them have a series long enough for a trend."""
    return found.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("n") >= MIN_POINTS).alias("with_series"))


def markers(df: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_index, label, n): the members' seasonality labels."""
    return df.where("seasonality <> ''").join(membership, "kw_idx").groupBy("cluster_index", F.col("seasonality").alias("label")).agg(F.count("*").alias("n"))


def _loess(y: np.ndarray, at: np.ndarray, span: int, robust: np.ndarray) -> np.ndarray:
    """Locally linear fits at `at` to y at 0, 1, ... by tricube weights on the `span` nearest points, times robustness weights."""
    n = len(y)
    x = np.arange(n, dtype=float)
    far = np.abs(at[:, None] - x)
    width = np.sort(far, 1)[:, min(span, n) - 1] + max(0, span - n) // 2
    near = far / np.maximum(width, 1e-300)[:, None]
    w = np.where(near <= 0.999, np.where(near <= 0.001, 1.0, (1 - np.minimum(near, 1.0) ** 3) ** 3), 0.0) * robust
    total = w.sum(1, keepdims=True)
    w = np.divide(w, total, out=np.zeros_like(w), where=total > 0)
    mean = w @ x
    var = (w * (x - mean[:, None]) ** 2).sum(1)
    tilt = np.where(np.sqrt(var) > 0.001 * (n - 1), np.divide(at - mean, var, out=np.zeros_like(var), where=var > 0), 0.0)
    fit = (w * (1 + tilt[:, None] * (x - mean[:, None]))) @ y
    return np.where(total[:, 0] > 0, fit, y[np.clip(at.round().astype(int), 0, n - 1)])


def _averages(x: np.ndarray, width: int) -> np.ndarray:
    return np.convolve(x, np.full(width, 1 / width), "valid")


def decompose(y: np.ndarray, period: int = PERIOD, seasonal: int = 7, inner: int = 2, outer: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seasonal, trend and remainder by loess (Cleveland and others, 1990), with robustness weights after the first of `outer` rounds."""
    n = len(y)
    odd = lambda v: (k := math.ceil(v)) + (k % 2 == 0)
    trend_span, low_span = odd(1.5 * period / (1 - 1.5 / seasonal)), odd(period + 1)
    robust, trend, cycle = np.ones(n), np.zeros(n), np.zeros(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            detrended, extended = y - trend, np.zeros(n + 2 * period)
            for k in range(period):
                part = detrended[k::period]
                extended[k::period] = _loess(part, np.arange(-1, len(part) + 1, dtype=float), seasonal, robust[k::period])
            low = _averages(_averages(_averages(extended, period), period), 3)
            cycle = extended[period : period + n] - _loess(low, np.arange(n, dtype=float), low_span, np.ones(n))
            trend = _loess(y - cycle, np.arange(n, dtype=float), trend_span, robust)
        rest = np.abs(y - cycle - trend)
        edge = 6 * np.median(rest)
        if turn == outer or edge == 0:
            break
        robust = np.where(rest <= 0.001 * edge, 1.0, np.where(rest <= 0.999 * edge, (1 - np.minimum(rest / edge, 1) ** 2) ** 2, 0.0))
    return cycle, trend, y - cycle - trend


def strength(component: np.ndarray, rest: np.ndarray, size: float = 1.0) -> float:
    """1 less the share of the remainder's variance in that of component and remainder, from 0 to 1; 0 where both vanish beside values of that size."""
    both = np.var(component + rest)
    return max(0.0, 1 - np.var(rest) / both) if both > (1e-10 * size) ** 2 else 0.0


def seasonal_strength(series: DataFrame, period: int = PERIOD) -> DataFrame:
    """grp, seasonal_strength, trend_strength of groups of two periods or more; a group is one series, as long as the calendar."""
    kind = series.schema["grp"].dataType.simpleString()

    def fit(key, rows):
        y = rows.sort_values("pos")["v"].to_numpy(float)
        cycle, trend, rest = decompose(y, period)
        size = float(np.abs(y).max())
        return pd.DataFrame({"grp": [key[0]], "seasonal_strength": [round(strength(cycle, rest, size), 6)], "trend_strength": [round(strength(trend, rest, size), 6)]})

    long = series.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * period).select("grp")
    return series.join(long, "grp", "left_semi").groupBy("grp").applyInPandas(fit, f"grp {kind}, seasonal_strength double, trend_strength double")
