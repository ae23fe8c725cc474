"""One value for each keyword that several sources report, weighted by the sources' reliability.

Weights are whole numbers, so that a weighted median is the exact median of a multiset; its partial aggregates (value to
weight) merge in any order and a keyword that holds a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L

MODES = ("median", "mean", "min", "max")
#: Weights in hundredths of the sources' reliability; others count OTHER.
OTHER = 70


def weight(source: Column) -> Column:
    """The source's reliability in hundredths."""
    table = F.create_map(*(F.lit(x) for k, v in L.SOURCE_RELIABILITY.items() for x in (k, round(100 * v))))
    return F.coalesce(F.element_at(table, source), F.lit(OTHER)).cast("long")


def _one(value: Column, mode: str) -> Column:
    value = value.cast("double")
    return {
        "median": F.percentile(value, F.lit(0.5), F.when(value.isNotNull(), F.col("_w")).otherwise(0)),
        "mean": F.sum(value * F.col("_w")) / F.sum(F.when(value.isNotNull(), F.col("_w"))), "min": F.min(value), "max": F.max(value),
    }[mode]


def reconcile(df: DataFrame, mode: str = "median", fields=("volume", "difficulty", "cpc")) -> DataFrame:
    """One row for each keyword: n_rows, n_sources, multi_source, the fields by mode, their spread, position, serp_features, intents.

    Position is that of Search Console where it has one, else the best; volume_confidence is 1 less the range over the sum of
    the volumes' extremes, 1 where they agree, null without any. Null values carry no weight; a null source counts as one of
    no name; df needs keyword and source, and of the other columns those that it has are used.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
    has = set(df.columns)
    source = F.coalesce("source", F.lit(""))
    out = [F.count("*").alias("n_rows"), F.count_distinct(source).alias("n_sources")]
    out += [F.round(_one(F.col(f), mode), 4).alias(f) for f in fields if f in has]
    if "volume" in has:
        low, high = F.min(F.col("volume").cast("double")), F.max(F.col("volume").cast("double"))
        out.append(F.when(low == high, 1.0).otherwise(F.round(2 * low / (high + low), 6)).alias("volume_confidence"))
    if "position" in has:
        out.append(F.coalesce(F.min(F.when(source == "gsc", F.col("position"))), F.min("position")).alias("position"))
    if "intent_label_raw" in has:
        out.append(F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim("intent_label_raw"), F.lit("")))), ",").alias("intents"))
    rows = df.withColumn("_w", weight(F.col("source"))).groupBy("keyword").agg(*out).withColumn("multi_source", F.col("n_sources") > 1)
    if "serp_features" not in has:
        return rows
    features = df.select("keyword", F.explode("serp_features").alias("f")).distinct().groupBy("keyword").agg(F.array_join(F.array_sort(F.collect_list("f")), "|").alias("serp_features"))  # of a closed set
    return rows.join(features, "keyword", "left").withColumn("serp_features", F.coalesce("serp_features", F.lit("")))


def flagged(df: DataFrame) -> DataFrame:
    """df with multi_source: whether another source reports the keyword too."""
    counts = df.groupBy("keyword").agg((F.count_distinct(F.coalesce("source", F.lit(""))) > 1).alias("multi_source"))
    return df.join(counts, "keyword", "left").withColumn("multi_source", F.coalesce("multi_source", F.lit(False)))
