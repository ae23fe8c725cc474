"""Corpus figures: summary, demand opportunity score, gaps, distributions, top lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIKING = ("top_page_climb", "second_page_break", "third_page_lift")


def shares(df: DataFrame) -> DataFrame:
    """One row: keywords, AIO and GEO shares, demand opportunity score."""
    mean = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    aio, geo = F.col("aio_label").isin("confirmed", "eligible"), F.col("geo_label").isin("dual", "geo_only")
    got = df.agg(F.count("*").alias("total_keywords"), F.coalesce(F.avg("score_main"), F.lit(0.0)).alias("m"), mean(F.col("quick_win") == "quick_win").alias("q"), mean(F.col("striking").isin(*STRIKING)).alias("s"), mean(aio).alias("a"), mean(geo).alias("g"))
    score = 100 * (0.30 * F.least(F.lit(1.0), F.col("m") / 100) + 0.25 * F.col("q") + 0.20 * F.col("s") + 0.15 * F.col("a") + 0.10 * F.col("g"))
    return got.select("total_keywords", F.round("a", 3).alias("aio_share"), F.round("g", 3).alias("geo_share"), F.round(score, 1).alias("demand_opportunity_score"))


def histograms(df: DataFrame) -> DataFrame:
    """(dimension, value, n) for source, language and intent, in one pass."""
    sets = df.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for d, c in (("source", "source"), ("language", "language"), ("intent", "query_type"))))).alias("x"))
    return sets.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def gaps(df: DataFrame, client: str, samples: int = 20) -> DataFrame:
    """(gap, n, samples) of keywords that only competitors rank for, and of AI answers without a top-ten rank."""
    url = F.coalesce("competitor_url", F.lit(""))
    lost = (url != "") & F.lit(client != "") & ~F.contains(url, F.lit(client)) & (F.col("position").isNull() | (F.col("position") > 100))
    unseen = F.col("aio_label").isin("confirmed", "eligible") & (F.col("position").isNull() | (F.col("position") > 10))
    rows = df.select("kw_idx", "keyword", F.explode(F.array(F.when(lost, "keyword_gap"), F.when(unseen, "aeo_geo_gap"))).alias("gap")).where("gap is not null")
    counted = rows.groupBy("gap").agg(F.count("*").alias("n"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("gap").orderBy("kw_idx"))).where(F.col("r") <= samples)  # a group limit, cut before the shuffle
    listed = first.groupBy("gap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "keyword"))), lambda x: x["keyword"]), "|").alias("samples"))
    return counted.join(listed, "gap")


def index_percentiles(df: DataFrame, column: str, shares_=(0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """(share, value): the value at index floor(n * share) of the ascending order, from value counts."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    up = counts.select("value", F.sum("n").over(Window.orderBy("value")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))  # one row a rounded score
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in shares_)))
    return up.select("*", wanted.alias("share")).where(F.col("upto") > F.least(F.floor(F.col("total") * F.col("share")), F.col("total") - 1)).groupBy("share").agg(F.min("value").alias("value"))


def action_histogram(df: DataFrame) -> DataFrame:
    """(action, n) over all actions, zeros included."""
    names = df.sparkSession.createDataFrame([(a,) for a in ("create", "update", "restructure", "monitor", "ignore")], "action string")
    return names.join(df.groupBy("action").agg(F.count("*").alias("n")), "action", "left").select("action", F.coalesce("n", F.lit(0)).alias("n"))


def top(df: DataFrame, score: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(score).desc(), "kw_idx").select("kw_idx", "keyword", score).limit(n)


# The format that suits an intent.
FORMAT_BY_INTENT = {
    "informational": "guide or explainer article",
    "commercial_investigation": "comparison or review page",
    "transactional": "product or category page",
    "navigational": "brand or destination page",
}


def briefs(df: DataFrame, clusters: DataFrame, membership: DataFrame, secondaries: int = 5, questions: int = 6) -> DataFrame:
    """cluster_index, head, size, volume_total, intent, format, action, primary, secondaries, questions (joined by a bar).

    The primary keyword has the most volume (the first of equals), secondaries follow it without repeats; questions are in
    the corpus's order; the action is that of most members (the first seen of equals). Keywords are told apart by their
    normal form and listed as they were written in the first of their rows, where df has keyword_original.
    """
    written = F.coalesce("keyword_original", "keyword") if "keyword_original" in df.columns else F.col("keyword")
    rows = df.select("kw_idx", "keyword", written.alias("written"), F.coalesce("volume", F.lit(0)).alias("v"), "question_shape", "action").join(membership, "kw_idx")
    distinct = rows.groupBy("cluster_index", "keyword").agg(F.max("v").alias("v"), F.min_by("kw_idx", F.struct(-F.col("v"), F.col("kw_idx"))).alias("at"), F.min(F.when(F.col("question_shape"), F.col("kw_idx"))).alias("asked"), F.min_by("written", "kw_idx").alias("written")).drop("keyword").withColumnRenamed("written", "keyword")
    by_volume = distinct.withColumn("r", F.row_number().over(Window.partitionBy("cluster_index").orderBy(F.col("v").desc(), "at"))).where(F.col("r") <= 1 + secondaries)
    listed = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(order, "keyword"))), lambda x: x["keyword"])
    best = by_volume.groupBy("cluster_index").agg(F.min_by("keyword", "r").alias("primary"), F.array_join(F.slice(listed("r"), 2, secondaries), "|").alias("secondaries"))
    asked = distinct.where("asked is not null").withColumn("q", F.row_number().over(Window.partitionBy("cluster_index").orderBy("asked"))).where(F.col("q") <= questions)
    asked = asked.groupBy("cluster_index").agg(F.array_join(listed("q"), "|").alias("questions"))
    by_action = rows.groupBy("cluster_index", "action").agg(F.count("*").alias("n"), F.min("kw_idx").alias("first"))
    action = by_action.groupBy("cluster_index").agg(F.max_by("action", F.struct("n", -F.col("first"))).alias("action"))
    form = F.create_map(*(F.lit(x) for kv in FORMAT_BY_INTENT.items() for x in kv))
    out = clusters.select("cluster_index", "head", "size", "volume_total", F.col("dominant_intent").alias("intent")).join(best, "cluster_index").join(action, "cluster_index").join(asked, "cluster_index", "left")
    return out.withColumn("questions", F.coalesce("questions", F.lit(""))).withColumn("format", F.coalesce(F.element_at(form, F.col("intent")), F.lit("article")))
