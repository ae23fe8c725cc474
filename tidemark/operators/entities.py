"""Entity analysis: term extraction, salience, ownership, co-occurrence graph, gaps, topical authority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .clusters import numbered_by_range, settle
from .keyphrases import keyphrases, no_stop_words

TOP_ENTITIES, TOP_NODES, TOP_GAPS = 200, 60, 50
OWNED_TO = 20


def with_terms(df: DataFrame, max_ngram: int = 2) -> DataFrame:
    """df with `terms`, which everything below reads: (term, first, new) of n-grams of adjacent tokens that are no stop words.

    first is the index of a term's first token, new marks its first occurrence in the row; a row is one keyword. Terms are
    much work for few bytes: store them if they are read more than once.
    """
    kept = F.transform("_t", lambda x, i: F.when(F.get("_keep", i), x))  # null for a stop word, which makes its n-grams null
    gram = lambda n: lambda x, i: F.struct(F.concat(x, *(y for k in range(1, n) for y in (F.lit(" "), F.get("_kept", i + k)))).alias("term"), i.alias("first"), F.lit(True).alias("new"))
    grams = F.filter(F.concat(*(F.transform("_kept", gram(n)) for n in range(1, max_ngram + 1))), lambda g: g["term"].isNotNull())
    df = df.withColumn("_t", X.tokens(F.col("keyword"))).withColumn("_keep", no_stop_words(F.col("language"), "_t")).withColumn("_kept", kept).withColumn("_grams", grams)
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams.term")) < F.size("_grams"), F.sort_array("_grams")))  # null where no term is repeated
    begins = lambda x, i: (i == 0) | (F.get("_sorted", i - 1)["term"] != x["term"])
    marked = F.transform("_sorted", lambda x, i: F.struct(x["term"].alias("term"), x["first"].alias("first"), begins(x, i).alias("new")))
    return df.withColumn("terms", F.coalesce(marked, "_grams")).drop("_t", "_keep", "_kept", "_grams", "_sorted")


def terms(df: DataFrame, *carried: str | Column) -> DataFrame:
    """(term, first, new) of each occurrence, with the carried columns of its row.

    Of a plain explode Spark infers a filter by size, into which it copies all that makes the terms, many times over.
    """
    df = df if "terms" in df.columns else with_terms(df)
    return df.select(*carried, F.explode_outer("terms").alias("_g")).where("_g is not null").select("*", "_g.*").drop("_g")


def held(df: DataFrame, entities: DataFrame, *carried: str | Column) -> DataFrame:
    """The entities of each row, once, with their columns and the row's; entities are few."""
    return terms(df, *carried).where("new").drop("first", "new").join(F.broadcast(entities), "term")


def extract(df: DataFrame, min_df: int = 2, max_ngram: int = 2) -> DataFrame:
    """term, tf, df, idf, position_factor, score of terms in at least min_df keywords. Counted within tasks first: only terms are shuffled."""
    df = df if "terms" in df.columns else settle(with_terms(df, max_ngram).select("terms"))  # read twice
    got = terms(df).groupBy("term").agg(F.count("*").alias("tf"), F.count_if("new").alias("df"), F.sum(F.when(F.col("new"), 1 / (1 + F.col("first")))).alias("p")).where(F.col("df") >= min_df)
    total = df.agg(F.count("*").alias("n"))
    factor = F.col("p") / F.col("df")
    return got.crossJoin(F.broadcast(total)).select("term", "tf", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"), F.round(factor, 6).alias("position_factor"), F.round(F.col("df") * factor, 6).alias("score"))  # one row of one number


#: Extractors by name: functions of a corpus that return (term, tf, df, idf, position_factor, score); more may be registered.
EXTRACTORS = {"ngram": extract, "statistical": keyphrases}


def extractor(name: str = "ngram"):
    if name not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name!r}; there are {sorted(EXTRACTORS)}")
    return EXTRACTORS[name]


def salient(df: DataFrame, top: int = TOP_ENTITIES, by: str = "ngram") -> DataFrame:
    """The most salient entities with rank, demand and ownership. df: kw_idx, keyword, language, volume, position."""
    best = settle(extractor(by)(df).orderBy(F.col("score").desc(), "term").limit(top))  # read twice below
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "term")))  # `top` rows
    owned = F.coalesce((F.col("position") > 0) & (F.col("position") <= OWNED_TO), F.lit(False))
    support = held(df, best.select("term"), F.coalesce("volume", F.lit(0)).alias("v"), owned.alias("owned"))
    figures = support.groupBy("term").agg(F.sum("v").alias("demand_volume"), F.count_if("owned").alias("owned_support"))
    return best.join(figures, "term").withColumns({"ownership_ratio": F.round(F.col("owned_support") / F.col("df"), 4), "owned": F.col("owned_support") > 0})


def graph(df: DataFrame, entities: DataFrame, nodes: int = TOP_NODES) -> DataFrame:
    """(a, b, weight): how many keywords two of the top entities share; a is the more salient."""
    own = held(df, entities.where(F.col("rank") <= nodes).select("term", "rank"), "kw_idx")
    per = own.groupBy("kw_idx").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("e"))  # at most `nodes` entries
    pairs = per.select(F.explode("e").alias("x"), "e").select("x", F.explode(F.filter("e", lambda y: y["rank"] > F.col("x.rank"))).alias("y"))
    return pairs.groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count("*").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("term"), "weight").unionByName(edges.select(F.col("b").alias("term"), "weight"))
    return ends.groupBy("term").agg(F.sum("weight").alias("degree"))


def gaps(entities: DataFrame, top: int = TOP_GAPS) -> DataFrame:
    return entities.where("not owned and demand_volume > 0").orderBy(F.col("demand_volume").desc(), "term").select("term", "demand_volume").limit(top)


def authority(df: DataFrame, entities: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_index, authority, weight): owned share of the demand of the entities that a cluster's keywords hold."""
    members = df.join(membership, "kw_idx")  # before their terms, which are more rows
    each = held(members, entities.select("term", "demand_volume", "owned"), "cluster_index").distinct()
    got = each.groupBy("cluster_index").agg(F.sum("demand_volume").alias("weight"), F.sum(F.when(F.col("owned"), F.col("demand_volume")).otherwise(0)).alias("o"))
    return got.select("cluster_index", F.when(F.col("weight") > 0, F.round(F.col("o") / F.col("weight"), 4)).otherwise(0.0).alias("authority"), "weight")


def in_order(authority_: DataFrame) -> DataFrame:
    """authority_ with place: 0 for the largest weight, the first cluster of equals; counted by ranges, not in one task."""
    at = F.struct((-F.col("weight")).alias("w"), "cluster_index")
    return numbered_by_range(authority_.withColumn("_at", at), "_at", "place").drop("_at")


def spread(df: DataFrame, entities: DataFrame, membership: DataFrame) -> DataFrame:
    """(term, clusters, dominant_cluster): the clusters of an entity's keywords, and that of most of them (the first seen of equals)."""
    each = held(df.join(membership, "kw_idx"), entities.select("term"), "kw_idx", "cluster_index")
    per = each.groupBy("term", "cluster_index").agg(F.count("*").alias("n"), F.min("kw_idx").alias("first"))
    return per.groupBy("term").agg(F.array_sort(F.collect_set("cluster_index")).alias("clusters"), F.max_by("cluster_index", F.struct("n", -F.col("first"))).alias("dominant_cluster"))


def gap_heads(found: DataFrame, spread_: DataFrame, clusters: DataFrame) -> DataFrame:
    """Entity gaps with the cluster that should close them and its head ('' where there is none)."""
    placed = found.join(spread_.select("term", F.col("dominant_cluster").alias("suggested_cluster")), "term", "left")
    heads = clusters.select(F.col("cluster_index").alias("suggested_cluster"), F.col("head").alias("suggested_head"))
    return placed.join(heads, "suggested_cluster", "left").select("term", "demand_volume", "suggested_cluster", F.coalesce("suggested_head", F.lit("")).alias("suggested_head"))
