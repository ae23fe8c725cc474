"""Queries of the documented extensions (graph measures, reconciliation, subclusters, cannibalisation) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import cannibal as N
from ..operators import clusters as C
from ..operators import entities as E
from ..operators import graphs as G
from ..operators import keywords as K
from ..operators import neighbours as near
from ..operators import reconcile as V
from ..operators import subclusters as U
from . import bindings as B
from . import modules as M
from . import sql as Q
from .catalog import CONFIG, clustered, engine, query

# ---------------------------------------------------------------- graph

_ROUNDS = 60
_WAYS = "wy as (select a, b, weight from ed union all select b, a, weight from ed), od as (select a, sum(weight) as out, count(*) as degree from wy group by 1)"


@query(Q.chain(M._TERMS, _WAYS).replace("with ", "with recursive ", 1) + f"""select term, round(rank, 9) as rank from (
 with recursive pr as (select a as term, 1.0::double / (select count(*) from od) as rank, 0 as k from od
 union all select b, 0.15::double / (select count(*) from od) + 0.85::double * sum(rank * weight / out), any_value(k) + 1 from pr join wy on a = term join od using (a) where k < {_ROUNDS} group by b)
 select term, rank from pr where k = {_ROUNDS}) x""")
def entity_pagerank(spark, sf):
    """PageRank of the entity graph."""
    ranks = G.pagerank(C.settle(E.graph(*M._entities(spark, sf))), rounds=_ROUNDS)
    return ranks.select("term", F.round("rank", 9).alias("rank"))


@query(Q.chain(M._TERMS, _WAYS) + """select term, cast(core as bigint) as core from (
 with recursive co as (select a as term, degree as core, 0 as k from od
 union all select a, least(any_value(own), max(least(core, above))), any_value(k) + 1 from
 (select a, core, k, own, sum(count(*)) over (partition by a order by core desc) as above from (select w.a, c.core, c.k, o.core as own from co c join wy w on w.b = c.term join co o on o.term = w.a) p where k < 40 group by a, core, k, own) q group by a)
 select term, core from co where k = 40) x""")
def entity_cores(spark, sf):
    """Core numbers of the entity graph."""
    return G.cores(C.settle(E.graph(*M._entities(spark, sf))))


# ---------------------------------------------------------------- reconciliation

_WEIGHT = Q.case("source", {k: round(100 * v) for k, v in L.SOURCE_RELIABILITY.items()}, V.OTHER)
_MEDIAN = "median({0}) filter ({0} is not null)".format
_MULTISET = f"rw as (select keyword, source, volume, difficulty, position, {_WEIGHT} as w from ac), rx as (select keyword, volume, difficulty, unnest(range(w)) as copy from rw)"
_UNION = "rf as (select keyword, array_to_string(list_sort(list(distinct f)), '|') as serp_features from (select keyword, unnest(serp_features) as f from ac) b group by 1)"
_BEST = "coalesce(min(position) filter (source = 'gsc'), min(position))"


@query(Q.chain(_MULTISET, _UNION) + f"""select keyword, n_rows, n_sources, n_sources > 1 as multi_source, volume, difficulty, volume_confidence, position, coalesce(serp_features, '') as serp_features from
 (select keyword, count(*) as n_rows, count(distinct source) as n_sources, {_BEST} as position, case when min(volume) = max(volume) then 1.0 else round(2 * min(volume)::double / (max(volume) + min(volume)), 6) end::double as volume_confidence from rw group by 1) a
 join (select keyword, round({_MEDIAN('volume')}, 4)::double as volume, round({_MEDIAN('difficulty')}, 4)::double as difficulty from rx group by 1) b using (keyword) left join rf using (keyword)""")
def reconciled_keywords(spark, sf):
    """One row for each keyword: medians weighted by the sources' reliability."""
    return V.reconcile(B.keywords(spark, sf)).drop("intents")


_MODES = " union all ".join(
    f"select '{mode}' as mode, keyword, {', '.join(f'round({what(c)}, 4)::double as {c}' for c in ('volume', 'difficulty'))} from {source} group by keyword"
    for mode, source, what in (("median", "rx", _MEDIAN), ("mean", "rw", "sum({0} * w)::double / sum(w) filter ({0} is not null)".format), ("min", "rw", "min({})".format), ("max", "rw", "max({})".format))
)


@query(Q.chain(_MULTISET) + _MODES)
def reconciled_modes(spark, sf):
    """The four ways of taking one value."""
    df = B.keywords(spark, sf)
    return reduce(lambda a, b: a.unionByName(b), (V.reconcile(df, mode).select(F.lit(mode).alias("mode"), "keyword", "volume", "difficulty") for mode in V.MODES))


@query(Q.chain() + "select kw_idx, keyword, (select count(distinct b.source) > 1 from ac b where b.keyword = ac.keyword) as multi_source from ac")
def multi_source(spark, sf):
    return V.flagged(B.keywords(spark, sf)).select("kw_idx", "keyword", "multi_source")


# ---------------------------------------------------------------- subclusters

#: Keywords of a subcluster here; the clusters of these tables are small.
_LIMIT = 5
_SPLIT = f"""sp_a as (select mb.cluster_index, kw_idx, keyword, coalesce(volume, 0) as v, concat(query_type, '/', {Q.case('query_type', {k: Q.q(v) for k, v in L.FUNNEL.items()}, "''")}) as intent from mb join ac using (kw_idx)),
sp_b as (select *, count(*) over (partition by cluster_index) as whole, count(*) over (partition by cluster_index, intent) as own, row_number() over (partition by cluster_index, intent order by v desc, kw_idx) - 1 as r from sp_a),
sp_c as (select kw_idx, keyword, v, cluster_index, case when whole > {_LIMIT} then intent end as intent, case when whole > {_LIMIT} then floor(r / ceil(own / ceil(own / {_LIMIT}.0)))::int end as piece from sp_b),
sp as (select cluster_index, intent, piece, min(kw_idx) as at_, arg_max(keyword, v * 1000000000 - kw_idx) as head, count(*) as size, cast(sum(v) as bigint) as volume_total from sp_c group by 1, 2, 3),
sn as (select *, row_number() over (order by at_) - 1 as subcluster from sp)"""


@query(Q.chain(_SPLIT) + "select subcluster, cluster_index, intent, piece, head, size, volume_total, size = 1 as singleton from sn")
def subclusters(spark, sf):
    """Clusters above the limit by intent and size."""
    df, _, membership = clustered(spark, sf)
    return U.split(df, membership, _LIMIT)[0]


@query(Q.chain(_SPLIT) + "select kw_idx, subcluster from sp_c join sn on sp_c.cluster_index = sn.cluster_index and sp_c.intent is not distinct from sn.intent and sp_c.piece is not distinct from sn.piece")
def subcluster_membership(spark, sf):
    df, _, membership = clustered(spark, sf)
    return U.split(df, membership, _LIMIT)[1]


# ---------------------------------------------------------------- cannibalisation

_PAGES = f"""cp as (select keyword, competitor_url as url, min(position) as position, bool_or(source = 'gsc') as gsc from ac where contains(competitor_url, '.{B.CLIENT}/') and not branded group by 1, 2),
cr as (select keyword, count(*) as urls, array_to_string(list_sort(list(url))[:20], '|') as evidence, case when count(*) > 1 then round(100 * (1 - least(2 * stddev_pop(coalesce(position, 100)), 100) / 100), 2) else 0 end::double as risk, case when count(*) > 1 and count(*) filter (gsc) > 1 then {N.SURE} else {N.LIKELY} end::double as confidence,
 case when count(*) > 1 then 'cannibalized' else 'no_risk' end as label from cp group by 1)"""


def _pages(spark, sf):
    """The client's pages of both runs; the runs differ in demand, not in their pages."""
    return N.pages([engine(spark, sf, when).select("keyword", "competitor_url", "position", "source", "branded") for when in (M._EARLY, M._LATE)], B.CLIENT)


@query(Q.chain(_PAGES) + "select keyword, urls, evidence, risk, confidence, label from cr")
def cannibalised_keywords(spark, sf):
    return N.keyword_risk(_pages(spark, sf))


@query(Q.chain(_PAGES) + """, cm as (select distinct cluster_index, keyword from mb join ac using (kw_idx)), cb as (select cluster_index, url, min(position) as position from cp join cm using (keyword) where position is not null group by 1, 2)
 select cluster_index, url, rival, gap, round(100 * (1 - least(gap, 100)::double / 100), 2) as competition from (select cluster_index, url, lead(url) over w as rival, lead(position) over w - position as gap from cb window w as (partition by cluster_index order by position, url)) b where rival is not null""".lstrip())
def cluster_rivals(spark, sf):
    df, _, membership = clustered(spark, sf)
    return N.cluster_rivals(_pages(spark, sf), membership.join(df.select("kw_idx", "keyword"), "kw_idx").select("keyword", "cluster_index"))


@query(Q.chain(_PAGES) + "select kw_idx, coalesce(risk, 0) as cannibalisation, round(0.30::double * (case when branded then 100 else 30 end) + 0.20::double * geo_score + 0.15::double * aio_score + 0.10::double * vs + 0.25::double * coalesce(risk, 0) + 1e-9, 1) as score_aeo from ac left join cr using (keyword)")
def defence_scores(spark, sf):
    """The defensive composite with the risk of cannibalisation in place of its constant 0."""
    df = B.keywords(spark, sf).withColumn("clustered", F.col("parent_topic").isNotNull())
    scoped = K.scopes(K.enrich(df, CONFIG), CONFIG)
    return K.scores(N.with_risk(scoped, N.keyword_risk(_pages(spark, sf))), CONFIG).select("kw_idx", "cannibalisation", "score_aeo")


# ---------------------------------------------------------------- embeddings


@query()
def embedding_clusters(spark, sf):
    """Clusters of a graph of nearest neighbours; SQL has no counterpart, tests hold recall and planted clusters."""
    vectors = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return near.embedding_clusters(vectors).select(F.col("id").alias("vec_id"), "cluster")
