"""Query fan-out: sibling heads, sub-queries of seven archetypes, BM25 coverage within clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from .clusters import settle

K1, B = 1.2, 0.75
ARCHETYPES = ("related", "implicit", "comparative", "recent", "personalized", "reformulation", "entity_expanded")
MOST = 12
#: Heads of one token that are all paired with each other, and hot tokens of a head whose sets are all formed.
HOT, MANY = 200, 8


def siblings(heads: DataFrame, top: int = 3, hot: int = HOT) -> DataFrame:
    """(cluster_index, sibling, jaccard, rank): the heads most alike, but not equal, by shared tokens. heads: cluster_index, head.

    Heads that share a token of at most `hot` heads are paired by it. Heads that share only hotter ones meet on the set of
    these: among the heads that hold a set, the shortest are most alike, so that 2 * top of them are enough, if at most `top`
    have the same tokens (those equal to a head aren't its siblings). Heads of over MANY hot tokens are paired by each of them.
    """
    t = heads.select("cluster_index", "head", F.explode(F.array_distinct(X.tokens(F.col("head")))).alias("token"))
    common = t.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("token", F.lit(True).alias("hot"))
    listed = lambda c: F.array_sort(F.collect_list(c))
    h = settle(t.join(common, "token", "left").groupBy("cluster_index", "head").agg(listed("token").alias("set"), listed(F.when(F.col("hot"), F.col("token"))).alias("hs")))
    a, b = h.select("cluster_index", F.col("set").alias("s"), "hs"), h.select(F.col("cluster_index").alias("other"), F.col("head").alias("sibling"), F.col("set").alias("o"), "hs")
    each = lambda df, tokens: df.withColumn("token", F.explode(tokens)).drop("hs")
    rare, broad = F.array_except(F.col("s"), "hs"), F.size("hs") > MANY
    pairs = each(a, rare).join(each(b, F.array_except(F.col("o"), "hs")), "token")
    pairs = pairs.unionByName(each(a.where(broad), "hs").join(each(b, "hs"), "token")).unionByName(each(a, "hs").join(each(b.where(broad), "hs"), "token")).drop("token")
    subsets = F.explode(F.expr("transform(sequence(1, shiftleft(1, size(hs)) - 1), m -> filter(hs, (x, i) -> shiftright(m, i) % 2 = 1))"))
    some = (F.size("hs") > 0) & ~broad
    held = b.where(some).select("other", "sibling", "o", subsets.alias("key"))
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("key", "o").orderBy("sibling", "other"))).where(F.col("r") <= top)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.size("o"), "sibling", "other"))).where(F.col("r") <= 2 * top).drop("r")  # group limits, cut before the shuffle
    pairs = pairs.unionByName(a.where(some).select("cluster_index", "s", subsets.alias("key")).join(few, "key").drop("key"))
    n = F.size(F.array_intersect("s", "o"))
    alike = pairs.dropDuplicates(["cluster_index", "other"]).select("cluster_index", "other", "sibling", (n / (F.size("s") + F.size("o") - n)).alias("jaccard")).where("jaccard < 1")
    order = Window.partitionBy("cluster_index").orderBy(F.col("jaccard").desc(), "sibling", "other")
    return alike.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster_index", "sibling", "jaccard", "rank")


def frequent_terms(docs: DataFrame, heads: DataFrame, top: int = 3) -> DataFrame:
    """(cluster_index, term, rank): members' most frequent tokens that the head lacks; ties: first seen. docs: cluster_index, kw_idx, keyword."""
    t = docs.select("cluster_index", "kw_idx", F.posexplode(X.tokens(F.col("keyword"))).alias("p", "term"))
    counted = t.groupBy("cluster_index", "term").agg(F.count("*").alias("n"), F.min(F.struct("kw_idx", "p")).alias("first"))
    own = heads.select("cluster_index", F.explode(X.tokens(F.col("head"))).alias("term")).distinct()
    left = counted.join(own, ["cluster_index", "term"], "left_anti")
    order = Window.partitionBy("cluster_index").orderBy(F.col("n").desc(), "first")
    return left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster_index", "term", "rank")


def sub_queries(heads: DataFrame, docs: DataFrame, neighbours: DataFrame | None = None, year: int = 2026) -> DataFrame:
    """(cluster_index, archetype, text, norm, rank): up to MOST for each cluster, round-robin over archetypes.

    neighbours: (head, term, rank) of a graph around heads that are entities; without them frequent terms are related.
    Duplicates (by normal form, and the head itself) keep the first in generation order.
    """
    h = heads.select("cluster_index", "head")
    found = frequent_terms(docs, h).join(h, "cluster_index")
    if neighbours is not None:
        near = neighbours.join(h, "head").withColumn("rank", F.row_number().over(Window.partitionBy("cluster_index").orderBy("rank"))).where("rank <= 3").select("cluster_index", "term", "rank", "head")
        found = near.unionByName(found.join(near.select("cluster_index").distinct(), "cluster_index", "left_anti").select("cluster_index", "term", "rank", "head"))
    row = lambda n, pos, text: ("cluster_index", F.lit(n).alias("a"), pos.cast("int").alias("pos"), text.alias("text"))
    parts = [found.select(*row(0, F.col("rank"), F.concat_ws(" ", "head", "term")))]
    parts.append(h.select("cluster_index", "head", F.posexplode(F.array(*(F.lit(w) for w in ("what", "why", "how", "when")))).alias("pos", "w")).select(*row(1, F.col("pos"), F.concat_ws(" ", "w", "head"))))
    parts.append(siblings(h).join(h, "cluster_index").select(*row(2, F.col("rank"), F.concat(F.col("head"), F.lit(" vs "), F.col("sibling")))))
    parts.append(h.select("cluster_index", "head", F.posexplode(F.array(*(F.lit(y) for y in (year, year + 1, year - 1)))).alias("pos", "y")).select(*row(3, F.col("pos"), F.concat_ws(" ", "head", F.col("y").cast("string")))))
    known = F.create_map(*(x for k, v in L.SYNONYMS.items() for x in (F.lit(k), F.array(*(F.lit(s) for s in v)))))
    tokens = h.select("cluster_index", X.tokens(F.col("head")).alias("t")).select("cluster_index", "t", F.posexplode("t").alias("at", "token"))
    swaps = tokens.select("cluster_index", "t", "at", F.posexplode(F.element_at(known, F.col("token"))).alias("k", "s"))
    swapped = F.array_join(F.transform("t", lambda x, i: F.when(i == F.col("at"), F.col("s")).otherwise(x)), " ")
    parts.append(swaps.select(*row(5, F.col("at") * 100 + F.col("k"), swapped)))
    if neighbours is not None:
        new = F.get(F.filter(X.tokens(F.col("term")), lambda x: ~F.array_contains(X.tokens(F.col("head")), x)), F.lit(0))
        parts.append(near.select("cluster_index", "rank", new.alias("new"), F.element_at(X.tokens(F.col("head")), -1).alias("last")).where("new is not null").select(*row(6, F.col("rank"), F.concat_ws(" ", "new", "last"))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.join(h, "cluster_index").withColumn("norm", X.norm_key(F.col("text"))).where((F.col("norm") != "") & (F.col("norm") != X.norm_key(F.col("head"))))
    once = every.withColumn("r", F.row_number().over(Window.partitionBy("cluster_index", "norm").orderBy("a", "pos"))).where("r = 1")
    in_bucket = once.withColumn("turn", F.row_number().over(Window.partitionBy("cluster_index", "a").orderBy("pos")))
    ranked = in_bucket.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_index").orderBy("turn", "a"))).where(F.col("rank") <= MOST)
    return ranked.select("cluster_index", F.element_at(F.array(*(F.lit(x) for x in ARCHETYPES)), F.col("a") + 1).alias("archetype"), "text", "norm", "rank")


def bm25(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(cluster_index, query, doc, score) of documents that share a term with a query of their cluster.

    queries: cluster_index, query, norm; docs: cluster_index, kw_idx, keyword. Repeated query terms count repeatedly.
    """
    d = docs.select("cluster_index", "kw_idx", X.tokens(F.col("keyword")).alias("t")).withColumn("dl", F.size("t"))
    size = d.groupBy("cluster_index").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    posting = d.select("cluster_index", "kw_idx", "dl", F.explode("t").alias("term")).groupBy("cluster_index", "term", "kw_idx", "dl").agg(F.count("*").alias("tf"))
    df = posting.groupBy("cluster_index", "term").agg(F.count("*").alias("df"))
    q = queries.select("cluster_index", "query", F.explode(F.split("norm", " ")).alias("term")).groupBy("cluster_index", "query", "term").agg(F.count("*").alias("qf"))
    hit = q.join(posting, ["cluster_index", "term"]).join(df, ["cluster_index", "term"]).join(size, "cluster_index")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("cluster_index", "query", F.col("kw_idx").alias("doc")).agg(F.sum(part).alias("score"))


def coverage(queries: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by query, by cluster): best score, centrality and covered; tau, coverage and missing archetypes."""
    best = scored.groupBy("cluster_index", "query").agg(F.max("score").alias("best"))
    q = queries.select("cluster_index", "query", "archetype").join(best, ["cluster_index", "query"], "left").withColumn("max_bm25", F.round(F.coalesce("best", F.lit(0.0)), 6))
    tau = q.groupBy("cluster_index").agg(F.round(F.median("max_bm25"), 6).alias("tau"))
    central = scored.join(tau, "cluster_index").where("tau > 0 and score >= tau").groupBy("cluster_index", "query").agg(F.count("*").alias("centrality"))
    q = q.join(tau, "cluster_index").join(central, ["cluster_index", "query"], "left").withColumns({"centrality": F.coalesce("centrality", F.lit(0)), "covered": (F.col("max_bm25") >= F.col("tau")) & (F.col("max_bm25") > 0)})
    by = q.groupBy("cluster_index").agg(
        F.first("tau").alias("tau"), F.round(F.avg(F.when(F.col("covered"), 1.0).otherwise(0.0)), 4).alias("coverage"),
        F.array_join(F.array_sort(F.array_except(F.collect_set("archetype"), F.collect_set(F.when(F.col("covered"), F.col("archetype"))))), ",").alias("missing"),
    )
    return q.select("cluster_index", "query", "archetype", "max_bm25", "centrality", "covered"), by


def gatekeepers(by_query: DataFrame, volumes: DataFrame) -> DataFrame:
    """Central sub-queries without demand of their own. volumes: norm, volume; queries are matched by normal form."""
    most = volumes.groupBy(F.col("norm").alias("query")).agg(F.max("volume").alias("volume"))
    return by_query.join(most, "query", "left").where("centrality >= 2 and coalesce(volume, 0) = 0").select("cluster_index", "query", "centrality")


def run_summary(coverage_: DataFrame, gatekeepers_: DataFrame | None = None) -> DataFrame:
    """One row: clusters, their mean coverage, and the gatekeepers of all."""
    out = coverage_.agg(F.count("*").alias("clusters"), F.coalesce(F.round(F.avg("coverage"), 4), F.lit(0.0)).alias("mean_coverage"))
    keepers = gatekeepers_.agg(F.count("*").alias("gatekeepers")) if gatekeepers_ is not None else None
    return out.crossJoin(F.broadcast(keepers)) if keepers is not None else out.withColumn("gatekeepers", F.lit(0).cast("long"))  # two rows of counts
