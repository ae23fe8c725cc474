"""Large clusters split by intent and size, singletons flagged.

A cluster of more than `limit` keywords falls into its intents (query type and funnel stage); an intent that is still
larger is cut into pieces of equal size, as few as keep the limit, along its keywords by descending volume. Positions along
that order come from ranges of the whole corpus, not from one task for each cluster, so that a cluster that holds a third
of all keywords is split by all tasks together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import numbered, numbered_by_range, settle

MOST = 200


def split(df: DataFrame, membership: DataFrame, limit: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(subclusters, membership): subcluster, cluster_index, intent, piece, head, size, volume_total, singleton; kw_idx, subcluster.

    df: kw_idx, keyword, volume, query_type, funnel_stage. Clusters within the limit stay whole (intent and piece null).
    Subclusters are numbered by the first keyword of theirs; the head has the largest volume, the first of equals; a null
    volume counts as 0 and a null intent is an intent.
    """
    intent = F.concat_ws("/", F.coalesce("query_type", F.lit("")), F.coalesce("funnel_stage", F.lit("")))
    rows = membership.join(df.select("kw_idx", "keyword", F.coalesce("volume", F.lit(0)).alias("v"), intent.alias("intent")), "kw_idx")
    sizes = rows.groupBy("cluster_index", "intent").agg(F.count("*").alias("own"))
    whole = sizes.groupBy("cluster_index").agg(F.sum("own").alias("size"))
    rows = settle(rows.join(sizes, ["cluster_index", "intent"]).join(whole, "cluster_index"))
    large, small = rows.where(F.col("size") > limit), rows.where(F.col("size") <= limit)
    at = F.struct("cluster_index", "intent", (-F.col("v")).alias("v"), "kw_idx")
    placed = settle(numbered_by_range(large.withColumn("at", at), "at", "no"))
    first = placed.groupBy("cluster_index", "intent").agg(F.min("no").alias("first"))
    pieces = F.ceil(F.col("own") / limit)
    cut = placed.join(first, ["cluster_index", "intent"]).withColumn("piece", F.floor((F.col("no") - F.col("first")) / F.ceil(F.col("own") / pieces)).cast("int"))
    columns = ["kw_idx", "keyword", "v", "cluster_index", "intent", "piece"]
    every = settle(cut.select(columns).unionByName(small.withColumns({"intent": F.lit(None).cast("string"), "piece": F.lit(None).cast("int")}).select(columns)))
    key = ["cluster_index", "intent", "piece"]
    found = every.groupBy(key).agg(F.min("kw_idx").alias("at"), F.max_by("keyword", F.struct("v", -F.col("kw_idx"))).alias("head"), F.count("*").alias("size"), F.sum("v").alias("volume_total"))
    subclusters = settle(numbered(found, "at", "subcluster").withColumn("singleton", F.col("size") == 1))
    alike = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    own = every.alias("a").join(subclusters.alias("b"), alike[0] & alike[1] & alike[2]).select("a.kw_idx", "b.subcluster")
    return subclusters.select("subcluster", "cluster_index", "intent", "piece", "head", "size", "volume_total", "singleton"), own
