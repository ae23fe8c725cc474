"""Graph measures over weighted edges (a, b, weight), each given once: PageRank and core numbers, in rounds of joins.

Both keep one row for each node; a round joins it to the edges and groups, which Spark combines before the shuffle, so that
a node with a third of all edges costs no task more. Every few rounds the rows are written and the change is looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import settle

#: Rounds between two writes.
SETTLED = 6


def both_ways(edges: DataFrame) -> DataFrame:
    """(source, target, weight) of both directions; edges of no weight, and from a node to itself, are none."""
    own = edges.where("weight > 0 and a <> b")
    return own.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight").unionByName(own.select(F.col("b").alias("source"), F.col("a").alias("target"), "weight"))


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 60, tolerance: float = 1e-12) -> DataFrame:
    """(term, rank): ranks sum to 1; stops early when no rank has moved by more than the tolerance over SETTLED rounds.

    The error falls by the damping with each round: after 60 rounds it is below 0.85^60, 6e-5 of the start's, at worst.
    """
    way = both_ways(edges)
    out = way.groupBy("source").agg(F.sum("weight").alias("out"))
    share = settle(way.join(out, "source").select("source", "target", (F.col("weight") / F.col("out")).alias("share")))
    n = out.count()
    ranks = settle(out.select(F.col("source").alias("term"), F.lit(1.0 / max(n, 1)).alias("rank")))
    for k in range(0, rounds, SETTLED):
        now = ranks
        for _ in range(min(SETTLED, rounds - k)):
            got = share.join(now, F.col("source") == F.col("term")).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
            now = got.select(F.col("target").alias("term"), ((1 - damping) / max(n, 1) + damping * F.col("got")).alias("rank"))
        now = settle(now)
        moved = now.join(ranks.withColumnRenamed("rank", "before"), "term").agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
        ranks = now
        if moved is None or moved <= tolerance:
            break
    return ranks


def cores(edges: DataFrame) -> DataFrame:
    """(term, core): the largest k such that the node is in a part of the graph where all have k neighbours or more.

    Core numbers are the fixed point of "as many neighbours as that have at least this value", from the degrees on; values
    only fall, so that it is reached, after rounds as many as the longest chain of such falls.
    """
    way = settle(both_ways(edges).select("source", "target").distinct())
    values = settle(way.groupBy(F.col("source").alias("term")).agg(F.count("*").alias("core")))
    above = Window.partitionBy("source").orderBy(F.col("core").desc())  # different values of a node's neighbours, a row each
    while True:
        counted = way.join(values, F.col("target") == F.col("term")).groupBy("source", "core").agg(F.count("*").alias("n"))
        best = counted.withColumn("n", F.sum("n").over(above)).groupBy("source").agg(F.max(F.least("core", "n")).alias("next"))
        now = settle(values.join(best, F.col("term") == F.col("source")).select("term", "core", "next"))
        if not now.where("next < core").limit(1).count():
            return values
        values = now.select("term", F.least("core", "next").alias("core"))
