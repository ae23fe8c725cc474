"""Cannibalisation: pages of the client that compete for the same keyword or within the same cluster, over two runs.

A page is a client URL with the best position that either run saw for it. A keyword is at risk when two or more of the
client's pages answer it; within a cluster, every page has a rival in the page next to it by position, and the closer the
two stand, the more they compete. Pages of one group are compared with their neighbours only, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Positions beyond this are one.
LAST = 100
#: Evidence by Search Console, and by rank tracking alone.
SURE, LIKELY = 0.9, 0.6


def pages(runs: list[DataFrame], client: str, branded: bool = False) -> DataFrame:
    """(keyword, url, position, gsc): the client's pages for each keyword, of all runs, with the best position (null: none known) and whether Search Console saw it; branded keywords are left out unless asked for."""
    out = None
    for df in runs:
        domain = X.domain(F.col("competitor_url"))
        own = df.where((domain == client) | domain.endswith("." + client))
        own = own if branded else own.where(~F.coalesce("branded", F.lit(False)))
        part = own.select("keyword", F.col("competitor_url").alias("url"), F.when(F.col("position").isNotNull(), F.least(F.col("position"), F.lit(LAST))).alias("position"), (F.coalesce("source", F.lit("")) == "gsc").alias("gsc"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("keyword", "url").agg(F.min("position").alias("position"), F.max("gsc").alias("gsc"))


def closeness(gap: Column) -> Column:
    """100 for pages side by side, falling to 0 at LAST positions apart."""
    return 100 * (1 - F.least(gap, F.lit(LAST)) / LAST)


def keyword_risk(found: DataFrame) -> DataFrame:
    """(keyword, urls, evidence, risk, confidence, label) of keywords with a page; found: see pages.

    risk is the closeness of the pages by the dispersion (population standard deviation) of their positions, unknown ones
    counting as LAST, and 0 for one page.
    """
    spread = F.stddev_pop(F.coalesce("position", F.lit(LAST)))
    n = F.count("*")
    rows = found.groupBy("keyword").agg(
        n.alias("urls"), F.array_join(F.slice(F.array_sort(F.collect_set("url")), 1, 20), "|").alias("evidence"), F.when(n > 1, F.round(closeness(2 * spread), 2)).otherwise(0.0).alias("risk"), F.count_if("gsc").alias("g")
    )  # a keyword's pages on one site
    return rows.select("keyword", "urls", "evidence", "risk", F.when((F.col("urls") > 1) & (F.col("g") > 1), SURE).otherwise(LIKELY).alias("confidence"), F.when(F.col("urls") > 1, "cannibalized").otherwise("no_risk").alias("label"))


def cluster_rivals(found: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_index, url, rival, gap, competition): each page of a cluster with the page next to it by position. members: keyword, cluster_index.

    A page's place in a cluster is its best position for any keyword of it; pages without one have no place. Of equal places
    the URLs' order decides.
    """
    best = found.where("position is not null").join(members.distinct(), "keyword").groupBy("cluster_index", "url").agg(F.min("position").alias("position"))
    along = Window.partitionBy("cluster_index").orderBy("position", "url")  # the client's pages in one cluster
    nearest = best.withColumns({"rival": F.lead("url").over(along), "gap": F.lead("position").over(along) - F.col("position")}).where("rival is not null")
    return nearest.select("cluster_index", "url", "rival", "gap", F.round(closeness(F.col("gap").cast("double")), 2).alias("competition"))


def with_risk(df: DataFrame, risk: DataFrame) -> DataFrame:
    """df with cannibalisation, the keyword's risk (0 without one), which the scores then take in place of a constant 0."""
    joined = df.join(risk.select("keyword", F.col("risk").alias("cannibalisation")), "keyword", "left")
    return joined.withColumn("cannibalisation", F.coalesce("cannibalisation", F.lit(0.0)))
