"""Queries of the modules' portfolio parts (opportunities, checklist, re-anchoring, seasonality, run changes) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import answers as A
from ..operators import clusters as C
from ..operators import compare as R
from ..operators import entities as E
from ..operators import fanout as O
from ..operators import pulse as P
from ..operators import summary as S
from ..sources import reports
from . import bindings as B
from . import modules as M
from . import sql as Q
from .catalog import _GAP, ORACLES, clustered, engine, query, with_clusters

BANDS = Q.chain(M._TERMS, M._AUTHORITY, M._SIGNALS, M._READY, M._BANDS)
_SPREAD = "sp_a as (select term, cluster_index, count(*) as n, min(kw_idx) as first from ex_a join mb using (kw_idx) where term in (select term from sa) group by 1, 2), sp as (select term, list_sort(list(cluster_index)) as clusters, arg_max(cluster_index, n * 1000000000 - first) as dominant_cluster from sp_a group by 1)"
_GAPS = "eg as (select term, demand_volume from sa where owned_support = 0 and demand_volume > 0 order by demand_volume desc, term limit 50)"


@query(Q.chain() + "select cluster_index, arg_max(language, n * 1000000000 - first) as language from (select cluster_index, language, count(*) as n, min(kw_idx) as first from mb join ac using (kw_idx) group by 1, 2) b group by 1")
def dominant_language(spark, sf):
    df, _, membership = clustered(spark, sf)
    return C.dominant_language(df, membership)


@query(Q.chain(M._GAP_TERMS, _SPREAD) + "select term, array_to_string(clusters, ',') as clusters, dominant_cluster from sp")
def entity_spread(spark, sf):
    df, entities = M._gap_entities(spark, sf)
    return E.spread(df, entities, C.parent_clusters(df)[1]).select("term", F.array_join("clusters", ",").alias("clusters"), "dominant_cluster")


@query(Q.chain(M._GAP_TERMS, _SPREAD, _GAPS) + "select term, demand_volume, dominant_cluster as suggested_cluster, coalesce(head, '') as suggested_head from eg left join sp using (term) left join cl on cl.cluster_index = dominant_cluster")
def gap_heads(spark, sf):
    df, entities = M._gap_entities(spark, sf)
    clusters, membership = C.parent_clusters(df)
    return E.gap_heads(E.gaps(entities), E.spread(df, entities, membership), clusters)


def _bands(spark, sf):
    df, _, membership, authority, ready = M._ready(spark, sf)
    return membership, authority, A.keyword_bands(df.join(membership, "kw_idx"), ready)


@query(BANDS + "select cluster_index, rank, kw_idx, cast(round_even(low, 0) as bigint) as low, cast(round_even(high, 0) as bigint) as high from (select *, row_number() over (partition by cluster_index order by round(high, 6) desc, kw_idx) as rank from kb) b where rank <= 6")
def top_opportunities(spark, sf):
    return A.top_opportunities(_bands(spark, sf)[2]).withColumn("rank", F.col("rank").cast("long"))


@query(BANDS + "select cluster_index, provenance, count(*) as n from kb group by 1, 2")
def provenance_mix(spark, sf):
    return A.provenance_mix(_bands(spark, sf)[2])


_CLUSTER_BANDS = "cb as (select kb.cluster_index, sum(cur) as c, least(sum(low), sum(high) * coalesce(0.7::double + 0.3::double * max(authority), 1)) as l, greatest(sum(low), sum(high) * coalesce(0.7::double + 0.3::double * max(authority), 1)) as h from kb left join au using (cluster_index) group by 1)"
_WHOLE = "cast(round_even({}, 0) as bigint)".format


@query(
    Q.chain(M._TERMS, M._AUTHORITY, M._SIGNALS, M._READY, M._BANDS, _CLUSTER_BANDS, M._OBSERVED)
    + f"""select cluster_index, matched, clicks as observed_clicks, mean_position, {_WHOLE('c')} as current_clicks, {_WHOLE('l')} as winnable_low, {_WHOLE('h')} as winnable_high,
 case when c is not null then greatest(0, {_WHOLE('c + l')} - clicks) end as observed_low, case when c is not null then greatest(0, {_WHOLE('c + h')} - clicks) end as observed_high
 from (select cluster_index, cast(sum(clicks) as bigint) as clicks, count(*) as matched, round(sum(position * impressions) filter (impressions > 0 and position is not null)::double / sum(impressions) filter (impressions > 0 and position is not null), 2) as mean_position from ob join nk using (norm) join mb using (kw_idx) group by 1) o left join cb using (cluster_index)"""
)
def reanchored_bands(spark, sf):
    membership, authority, bands = _bands(spark, sf)
    found = A.cluster_bands(bands, authority=authority)
    kw, observed = M._observed(spark, sf)
    return A.reanchored(found, A.observed_clicks(observed, kw, membership))


_LIST = lambda items: f"coalesce(array_to_string(({items})[1:8], '|'), '')"
_QUESTIONS = f"qs as (select cluster_index, list_sort(list(distinct keyword) filter (question_paa <> 'neither' or question_shape or {M._has('featured_snippet', 'paa', 'ai_overview')})) as q from mb join ac using (kw_idx) group by 1)"
_REWARDED = "rw as (select cluster_index, list(f order by n desc, f) as r from (select cluster_index, f, count(*) as n from (select cluster_index, unnest(serp_features) as f from mb join ac using (kw_idx)) x where f in ('featured_snippet', 'paa', 'shopping') group by 1, 2) y group by 1)"
_OWN = "ow as (select dominant_cluster as cluster_index, list_sort(list(term)) as o from sp group by 1), og as (select dominant_cluster as cluster_index, list(term order by demand_volume desc, term) as g from eg join sp using (term) group by 1)"
_ITEMS = {
    "extractability": (f"case when len(q) > 0 then {Q.q(L.CHECKLIST_BASIS['questions'])} else {Q.q(L.CHECKLIST_BASIS['no_questions'])} end", _LIST("q")),
    "entity_coverage": (Q.q(L.CHECKLIST_BASIS["entities"]), _LIST("coalesce(g, o)")),
    "structured_signals": (f"case when len(r) > 0 then {Q.q(L.CHECKLIST_BASIS['features'])} else {Q.q(L.CHECKLIST_BASIS['no_features'])} end", _LIST("r")),
    "information_gain": (Q.q(L.CHECKLIST_BASIS["fan_out"]), "coalesce(nullif(missing, ''), '')"),
    "freshness_proxy": (Q.q(L.CHECKLIST_BASIS["no_state"]), "''"),
    "source_cues": (Q.q(L.CHECKLIST_BASIS["sources"]), "''"),
}
_MISSING = "fm as (select cluster_index, case when count(*) filter (m >= tau and m > 0) = 0 then 'implicit' else '' end as missing from (select *, round(median(m) over (partition by cluster_index), 6) as tau from (select bq.cluster_index, bq.query, round(coalesce(max(score), 0), 6) as m from bq left join bs using (cluster_index, query) group by 1, 2) x) y group by 1)"


@query(
    Q.chain(M._GAP_TERMS, M._BM, _SPREAD, _GAPS, _QUESTIONS, _REWARDED, _OWN, _MISSING)
    + " union all ".join(f"select cluster_index, '{name}' as component, {Q.q(L.CHECKLIST[name][0])} as requires, {basis} as basis, {Q.q(L.CHECKLIST[name][1])} as action, {examples} as examples from qs left join rw using (cluster_index) left join ow using (cluster_index) left join og using (cluster_index) left join fm using (cluster_index)" for name, (basis, examples) in _ITEMS.items())
)
def citation_checklist(spark, sf):
    df, entities = M._gap_entities(spark, sf)
    _, clusters, membership = with_clusters(df)
    spread = C.settle(E.spread(df, entities, membership))
    queries, docs = M._asked(df, clusters, membership)
    covered = O.coverage(queries, C.settle(O.bm25(queries, docs)))[1]
    fan = covered.select("cluster_index", F.array().cast("array<string>").alias("gatekeepers"), F.filter(F.split("missing", ","), lambda a: a != "").alias("missing"))
    return A.checklist(df, membership, spread, E.gap_heads(E.gaps(entities), spread, clusters), fan)


@query(Q.chain(M._BM, _MISSING.replace("case when count(*) filter (m >= tau and m > 0) = 0 then 'implicit' else '' end as missing", "round(avg(case when m >= tau and m > 0 then 1.0::double else 0 end), 4) as coverage")) + "select count(*) as clusters, round(avg(coverage), 4) as mean_coverage, 0::bigint as gatekeepers from fm")
def coverage_summary(spark, sf):
    queries, docs = M._implicit(spark, sf)
    return O.run_summary(O.coverage(queries, O.bm25(queries, docs))[1])


@query(Q.chain() + "select cluster_index, seasonality as label, count(*) as n from mb join ac using (kw_idx) group by 1, 2")
def seasonality_markers(spark, sf):
    df, _, membership = clustered(spark, sf)
    return P.markers(df, membership)


@query(ORACLES["demand_states"].replace("select grp, case", "select state, count(*) as n, count(*) filter (n >= 8) as with_series from (select grp, n, case") + ") c group by 1")
def demand_state_counts(spark, sf):
    return P.state_counts(P.states(B.series(spark, sf)))


@query()
def seasonal_strength(spark, sf):
    """Strength of the yearly cycle; the decomposition is iterative, tested on made series."""
    return P.seasonal_strength(B.series(spark, sf))


@query()
def seasonal_states(spark, sf):
    """Demand states with the seasonal one."""
    series = B.series(spark, sf)
    return P.states(series, P.seasonal_strength(series)).select("grp", "state", "seasonal_strength")


def _runs(spark, sf):
    """Keywords with demand in the earlier and in the later period."""
    return tuple(engine(spark, sf, when).where("volume > 0") for when in (M._EARLY, M._LATE))


_RUN = lambda when, cte, final: "(" + Q.chain(*cte).replace("from lineitem where true", f"from lineitem where {when}") + final + ")"
_BY_INTENT = "select query_type as value, count(*) as n from ac where volume > 0 group by 1"


@query(f"select value, coalesce(b.n, 0) as base, coalesce(c.n, 0) as current, coalesce(c.n, 0) - coalesce(b.n, 0) as delta from {_RUN(M._EARLY, (), _BY_INTENT)} b full join {_RUN(M._LATE, (), _BY_INTENT)} c using (value)")
def intent_shift(spark, sf):
    return R.intent_shift(*_runs(spark, sf))


_SAMPLES = "select gap, max(n) as n, list(keyword order by kw_idx) as s from (select *, count(*) over (partition by gap) as n, row_number() over (partition by gap order by kw_idx) as r from gp) b where r <= 20 group by gap"
_RUN_GAP = _GAP.replace("from ac where", "from ac where volume > 0 and")
_EXCEPT = "array_to_string(list_sort(list_distinct(list_filter({}, lambda k: not list_contains({}, k)))), '|')".format


@query(f"""select gap, coalesce(b.n, 0) as base_count, coalesce(c.n, 0) as current_count, coalesce(c.n, 0) - coalesce(b.n, 0) as delta, {_EXCEPT('coalesce(b.s, [])', 'coalesce(c.s, [])')} as closed, {_EXCEPT('coalesce(c.s, [])', 'coalesce(b.s, [])')} as opened,
 coalesce(b.n, 0) > len(list_distinct(coalesce(b.s, []))) or coalesce(c.n, 0) > len(list_distinct(coalesce(c.s, []))) as partial from {_RUN(M._EARLY, (_RUN_GAP,), _SAMPLES)} b full join {_RUN(M._LATE, (_RUN_GAP,), _SAMPLES)} c using (gap)""")
def gap_changes(spark, sf):
    base, current = (S.gaps(df, B.CLIENT) for df in _runs(spark, sf))
    return R.gap_changes(base, current)


_BRIEF = f"""bi as (select cluster_index, arg_max(query_type, n * 1000000000 - first) as intent, cast(sum(n) as bigint) as size, cast(sum(v) as bigint) as volume_total from (select cluster_index, query_type, count(*) as n, min(kw_idx) as first, sum(coalesce(volume, 0)) as v from mb join ac using (kw_idx) group by 1, 2) x group by 1),
ba as (select cluster_index, arg_max(action, n * 1000000000 - first) as action from (select cluster_index, action, count(*) as n, min(kw_idx) as first from mb join ac using (kw_idx) group by 1, 2) x group by 1),
bd as (select cluster_index, keyword, max(coalesce(volume, 0)) as v, arg_max(kw_idx, coalesce(volume, 0) * 1000000000 - kw_idx) as seen, min(kw_idx) filter (question_shape) as asked from mb join ac using (kw_idx) group by 1, 2),
br as (select *, row_number() over (partition by cluster_index order by v desc, seen) as r, row_number() over (partition by cluster_index order by asked nulls last) as q from bd),
bp as (select cluster_index, arg_min(keyword, r) as "primary", coalesce(string_agg(keyword, '|' order by r) filter (r between 2 and 6), '') as secondaries, coalesce(string_agg(keyword, '|' order by q) filter (asked is not null and q <= 6), '') as questions from br group by 1)"""


@query(Q.chain(_BRIEF) + f"select cluster_index, head, bi.size, bi.volume_total, intent, action, \"primary\", secondaries, questions, {Q.case('intent', {k: Q.q(v) for k, v in S.FORMAT_BY_INTENT.items()}, Q.q('article'))} as format from cl join bi using (cluster_index) join ba using (cluster_index) join bp using (cluster_index)")
def cluster_briefs(spark, sf):
    df, clusters, membership = clustered(spark, sf)
    return S.briefs(df, C.describe(clusters.select("cluster_index", "head"), membership, df), membership)


_YES = "case when {} then 'yes' else '' end".format
_FULL = {
    "keyword": "keyword", "keyword_original": "null", "source": "source", "language": "language", "country": "null", "volume": "volume", "difficulty": "difficulty", "cpc": "null", "position": "position", "serp_features": "array_to_string(serp_features, ',')",
    "traffic_potential": "null", "clicks": "clicks", "impressions": "impressions", "ctr": "null", "intent_query_type": "query_type", "intent_funnel_stage": Q.case("query_type", {k: Q.q(v) for k, v in L.FUNNEL.items()}, "null"), "intent_modality": "modality",
    "intent_temporal": "temporal", "cluster_head": "coalesce(head, '')", "cluster_size": "coalesce(sz, 0)", "aio_eligibility": "aio_label", "geo_opportunity": "geo_label", "quick_win_flag": _YES("wins"), "striking_distance_flag": "case when strikes then striking else '' end",
    "branded_flag": _YES("branded"), "question_flag": _YES("question_shape"), "paa_flag": _YES("paa"), "seasonality_class": "seasonality", "long_tail_flag": "long_tail", "score_main": "score_main", "score_quick_win": "score_quick_win", "score_strategic": "score_strategic",
    "score_aeo_defensive": "score_aeo", "confidence_main": "confidence_main", "confidence_quick_win": "case when wins then 0.85 else 0.0 end", "confidence_strategic": "0.8", "confidence_aeo_defensive": "0.8", "recommended_action_class": "action", "source_file": "null", "source_row": "null",
}


@query(Q.chain() + "select " + ", ".join(f"{v} as {k}" for k, v in _FULL.items()) + " from ac left join mb using (kw_idx) left join (select cluster_index, head, size as sz from cl) c using (cluster_index)")
def enriched_full(spark, sf):
    df, clusters, membership = clustered(spark, sf)
    return reports.enriched(df, C.describe(clusters.select("cluster_index", "head"), membership, df), membership).withColumn("confidence_quick_win", F.round("confidence_quick_win", 4))
