"""Clusters: parent-topic seeds, then leader clustering on stems, as an order-respecting maximal independent set.

Visiting keywords by descending volume, a keyword joins the head that it overlaps most (at least `overlap`), or else
becomes a head. The heads are the lexicographically first maximal independent set of the graph whose edges join
sufficiently overlapping stem sets, which is found in rounds: a keyword with an earlier head beside it is a member, one
whose earlier neighbours are all members is a head. Candidate pairs come from an equi-join on the rarest stems of each set
(prefix filter), so that a frequent stem pairs only sets that have no rarer ones.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local master may do without spark.checkpoint.dir; it then gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: How much larger rows may be in a broadcast than in their stored, compressed form: a number that takes a byte takes 64 there.
INFLATION = 100
_FACTOR = "spark.sql.sources.fileCompressionFactor"


def settle(df: DataFrame) -> DataFrame:
    """Write df once in the session's shared checkpoint folder and read it back: cuts the lineage without computing it twice.

    Spark takes a file's size for that of its rows, and a few columns' share of it by their types, so that it would gather
    millions of stored rows on the driver to broadcast them. The session is told how compressed files may be, if it has no
    larger factor; joins then start as shuffles, and become broadcasts by the sizes that are measured there.
    """
    spark = df.sparkSession
    if float(spark.conf.get(_FACTOR, "1.0")) < INFLATION:
        spark.conf.set(_FACTOR, str(float(INFLATION)))
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, at: str, name: str, bits: int = 20) -> DataFrame:
    """Consecutive numbers from 0 by the distinct non-negative whole numbers `at`, counted within blocks of 2^bits of these.

    Only the blocks' totals, one row for 2^bits values, are ordered in one task.
    """
    return _by_block(df.withColumn("_block", F.shiftright(F.col(at).cast("long"), bits)), at, name)


def numbered_by_range(df: DataFrame, at: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 by any distinct sortable values, counted within ranges of these; df should be stored."""
    return _by_block(settle(df.repartitionByRange(F.col(at)).withColumn("_block", F.spark_partition_id())), at, name)


def _by_block(dealt: DataFrame, at: str, name: str) -> DataFrame:
    """Numbers within ascending blocks, after the rows of the blocks before."""
    totals = dealt.groupBy("_block").agg(F.count("*").alias("_n"))
    before = totals.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # one row a block
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_block").orderBy(at)))
    return own.join(before, "_block").withColumn(name, (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_block", "_own", "_before")


def parent_clusters(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, membership) of the parent topics, numbered by first appearance. df: kw_idx, keyword, volume, parent_topic."""
    clusters = topic_clusters(df)
    return clusters, topic_members(df, clusters)


def topic_clusters(df: DataFrame) -> DataFrame:
    own = _with_topic(df).select("parent_topic", "kw_idx", "keyword", F.coalesce("volume", F.lit(0)).alias("v"))
    heads = own.groupBy("parent_topic").agg(F.min("kw_idx").alias("first"), F.max_by(F.struct("kw_idx", "keyword"), F.struct("v", -F.col("kw_idx"))).alias("h"))
    return numbered(heads, "first", "cluster_index").select("cluster_index", F.col("h.keyword").alias("head"), F.col("h.kw_idx").alias("head_idx"), "parent_topic", F.lit(0.95).alias("confidence"))


def topic_members(df: DataFrame, clusters: DataFrame) -> DataFrame:
    return _with_topic(df).select("parent_topic", "kw_idx").join(clusters.select("parent_topic", "cluster_index"), "parent_topic").select("kw_idx", "cluster_index")


def _with_topic(df: DataFrame) -> DataFrame:
    return df.where("parent_topic is not null and parent_topic <> ''")


def _prefixes(sets: DataFrame, counts: DataFrame, overlap: float) -> DataFrame:
    """(set, stem): each set's rarest stems, as many as must hold a stem that any set of enough overlap shares."""
    ranked = sets.select("set", F.explode("set").alias("stem")).join(counts, "stem").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("n", "stem"))).alias("by"))
    needed = F.ceil(overlap * F.size("by") - 1e-9).cast("int")  # a little less only lengthens the prefix
    return ranked.select("set", F.explode(F.slice("by", F.lit(1), F.size("by") - needed + 1)).alias("x")).select("set", F.col("x.stem").alias("stem"))


def _candidates(sets: DataFrame, against: DataFrame, overlap: float) -> DataFrame:
    """Pairs (s, h) of sets of distinct stems with their overlap, at least `overlap` of the larger one."""
    sets, against = sets.select("set").distinct(), against.select("set").distinct()
    counts = sets.unionByName(against).select(F.explode("set").alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))
    a = _prefixes(sets, counts, overlap).select(F.col("set").alias("s"), "stem")
    b = _prefixes(against, counts, overlap).select(F.col("set").alias("h"), "stem")
    ns, nh = F.size("s"), F.size("h")
    near = a.join(b, "stem").where(F.least(ns, nh) >= overlap * F.greatest(ns, nh)).select("s", "h").distinct()
    return near.withColumn("overlap", F.size(F.array_intersect("s", "h")) / F.greatest(ns, nh)).where(F.col("overlap") >= overlap)


def leader_clusters(df: DataFrame, overlap: float = 0.60) -> tuple[DataFrame, DataFrame]:
    """(clusters, membership) of both passes. df: kw_idx, keyword, language, volume, parent_topic."""
    spark = df.sparkSession
    seeds, seeded = parent_clusters(df)
    base = df.withColumn("set", F.array_sort(F.array_distinct(X.stems(F.col("keyword"), F.col("language"))))).select("kw_idx", "keyword", F.coalesce("volume", F.lit(0)).alias("v"), "parent_topic", "set")
    base = settle(base)
    seed_heads = settle(seeds.join(base.select(F.col("kw_idx").alias("head_idx"), "set"), "head_idx").where("size(set) > 0").select("set", "cluster_index"))
    free = base.where("(parent_topic is null or parent_topic = '') and size(set) > 0")
    # visiting order without a global sort: (volume descending, index ascending) as a comparable struct
    order = F.struct((-F.col("v")).alias("v"), F.col("kw_idx").alias("i"))
    free = settle(free.withColumn("at", order))
    distinct = settle(free.groupBy("set").agg(F.min("at").alias("at")))  # of equal sets only the first can be a head
    taken = _candidates(distinct, seed_heads.select("set").distinct(), overlap).select(F.col("s").alias("set")).distinct()
    nodes = settle(distinct.join(taken, "set", "left_anti"))
    pairs = _candidates(nodes, nodes, overlap).where("s <> h").select("s", "h")
    edges = settle(pairs.join(nodes.select(F.col("set").alias("s"), F.col("at").alias("sa")), "s").join(nodes.select(F.col("set").alias("h"), F.col("at").alias("ha")), "h").where("ha < sa").select("s", "h"))
    heads, open_ = spark.createDataFrame([], nodes.select("set", "at").schema), nodes
    while open_.limit(1).count():
        new = settle(open_.join(edges.select(F.col("s").alias("set")), "set", "left_anti"))  # no earlier undecided neighbour
        member = edges.join(new.select(F.col("set").alias("h")), "h", "left_semi").select(F.col("s").alias("set")).distinct()
        heads = settle(heads.unionByName(new.select("set", "at")))
        open_ = settle(open_.join(new, "set", "left_anti").join(member, "set", "left_anti"))
        left = open_.select("set")
        edges = settle(edges.join(left.select(F.col("set").alias("s")), "s", "left_semi").join(left.select(F.col("set").alias("h")), "h", "left_semi"))
    seeds_n = seeds.count()
    indexed = settle(numbered_by_range(heads, "at", "cluster_index").withColumn("cluster_index", F.col("cluster_index") + F.lit(seeds_n).cast("long")))
    made = indexed.join(free.select("kw_idx", "keyword"), F.col("at.i") == F.col("kw_idx")).select("cluster_index", F.col("keyword").alias("head"), F.col("kw_idx").alias("head_idx"), F.lit(None).cast("string").alias("parent_topic"), F.lit(0.7).alias("confidence"))
    all_heads = seed_heads.withColumn("at", F.struct(F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("i"))).unionByName(indexed.select("set", "cluster_index", "at"))
    near = settle(_candidates(distinct, all_heads.select("set").distinct(), overlap)).join(all_heads.select(F.col("set").alias("h"), "cluster_index", F.col("at").alias("ha")), "h")
    ranked = free.select("kw_idx", F.col("set").alias("s"), "at").join(near, "s").where("ha.i is null or ha <= at")
    best = ranked.groupBy("kw_idx").agg(F.max_by("cluster_index", F.struct("overlap", -F.col("cluster_index"))).alias("cluster_index"))
    return seeds.unionByName(made), seeded.unionByName(best)


def describe(clusters: DataFrame, membership: DataFrame, df: DataFrame) -> DataFrame:
    """clusters with size, volume_total and dominant intent (ties: the intent that comes first)."""
    rows = membership.join(df.select("kw_idx", "volume", "query_type"), "kw_idx")
    by_intent = rows.groupBy("cluster_index", "query_type").agg(F.count("*").alias("n"), F.min("kw_idx").alias("first"), F.sum(F.coalesce("volume", F.lit(0))).alias("v"))
    total = by_intent.groupBy("cluster_index").agg(F.sum("n").alias("size"), F.sum("v").alias("volume_total"), F.max_by("query_type", F.struct("n", -F.col("first"))).alias("dominant_intent"))
    return clusters.join(total, "cluster_index")


def dominant_language(df: DataFrame, membership: DataFrame, other: str = "en") -> DataFrame:
    """(cluster_index, language): the members' most frequent language, the first seen of equals; `other` where none has one."""
    rows = membership.join(df.select("kw_idx", "language"), "kw_idx")
    by = rows.where("language <> ''").groupBy("cluster_index", "language").agg(F.count("*").alias("n"), F.min("kw_idx").alias("first"))
    best = by.groupBy("cluster_index").agg(F.max_by("language", F.struct("n", -F.col("first"))).alias("language"))
    return rows.select("cluster_index").distinct().join(best, "cluster_index", "left").select("cluster_index", F.coalesce("language", F.lit(other)).alias("language"))
