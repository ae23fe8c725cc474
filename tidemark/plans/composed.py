"""Modules with all of their inputs: readiness by six signals, click bands by three adjusters, fan-out along the entity graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import answers as A
from ..operators import clusters as C
from ..operators import entities as E
from ..operators import fanout as O
from ..operators import pulse as P
from . import bindings as B
from . import modules as M
from . import pipeline
from . import sql as Q
from .catalog import CONFIG, engine, query, with_clusters

_FAN = (M._SIB, M._DOCS.rstrip().rstrip(","), M._TERMS3, M._ASKED, M._SCORED, M._FAN)
_COVERED = "cv as (select cluster_index, round(avg(case when covered then 1.0::double else 0 end), 4) as coverage from fq group by 1)"
_SERIES = "sr as (select grp, row_number() over (partition by grp order by m) - 1 as pos, v from (select cluster_index as grp, date_trunc('month', l_shipdate) as m, cast(sum(l_quantity) as double) as v from lineitem join mb on kw_idx = l_partkey group by 1, 2) b)"
_STATES = "st as (select grp as cluster_index, case when n < 8 then 'unknown' when abs(z) > 1.959963984540054 and slope > 0 then 'rising' when abs(z) > 1.959963984540054 and slope < 0 then 'declining' else 'flat' end as state from zs join sl using (grp))"
_INPUTS = {"eligibility": "eligibility", "query_family": "coverage", "entity_coverage": "authority", "extractability": "extractability", "structured_demand": "structured_demand", "freshness": "fresh"}
_W = {k: f"{v}::double" for k, v in L.READINESS_WEIGHTS.items()}
_READY = f"""rd_a as (select sg.*, authority, coverage, state, cast({Q.case('state', L.FRESHNESS, 'null')} as double) as fresh from sg left join au using (cluster_index) left join cv using (cluster_index) left join st using (cluster_index)),
rd_b as (select *, {' + '.join(f'case when {c} is null then 0 else {_W[k]} end' for k, c in _INPUTS.items())} as tw from rd_a),
rd as (select cluster_index, demand, authority, coverage, state, round(100 * ({' + '.join(f'coalesce({c} * round({_W[k]} / tw, 6), 0)' for k, c in _INPUTS.items())}), 4) as readiness from rd_b)"""
_ALL = Q.chain(M._TERMS, M._AUTHORITY, M._SIGNALS, *_FAN, _COVERED, _SERIES, M._MK, M._Z, _STATES, _READY)


def _signals(spark, sf):
    """Everything the modules take, each computed once: corpus, membership, readiness, authority, coverage, state."""
    df, entities = M.with_entities(engine(spark, sf))
    _, clusters, membership = with_clusters(df)
    authority = C.settle(E.authority(df, entities, membership))
    docs = C.settle(membership.join(df.select("kw_idx", "keyword"), "kw_idx"))
    made = C.settle(O.sub_queries(clusters, docs, year=M._YEAR))
    queries = made.select("cluster_index", F.col("norm").alias("query"), "norm", "archetype")
    coverage = C.settle(O.coverage(queries, C.settle(O.bm25(queries, docs)))[1])
    shipped = B.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("kw_idx"), F.date_trunc("month", "l_shipdate").alias("period")).agg(F.sum("l_quantity").cast("double").alias("value"))
    state = C.settle(P.states(C.settle(P.cluster_series(shipped, membership))).withColumnRenamed("grp", "cluster_index"))
    ready = C.settle(A.readiness(A.cluster_signals(df, membership), authority, coverage, state))
    return df, membership, ready, authority, coverage, state


@query(_ALL + "select cluster_index, readiness, round(100 * readiness * demand / sum(readiness * demand) over (), 4) as expected_share, coverage, state from rd")
def full_readiness(spark, sf):
    """Citation readiness by all six inputs, with the two that the plain query lacks."""
    _, _, ready, _, coverage, state = _signals(spark, sf)
    return ready.join(coverage.select("cluster_index", "coverage"), "cluster_index", "left").join(state.select("cluster_index", "state"), "cluster_index", "left")


_FACTOR = lambda k: f"coalesce(cast({Q.case('state', {s: v[k] for s, v in L.DEMAND_FACTORS.items()}, 'null')} as double), 1)"


@query(_ALL.rstrip() + ",\n" + M._BANDS + f""" select cluster_index, cast(round_even(c, 0) as bigint) as current_clicks, cast(round_even(least(l, h), 0) as bigint) as winnable_low, cast(round_even(greatest(l, h), 0) as bigint) as winnable_high, cast(round_even(c + least(l, h), 0) as bigint) as ceiling_low, cast(round_even(c + greatest(l, h), 0) as bigint) as ceiling_high, round(ai, 4) as ai_share
 from (select cluster_index, c, ai, l * {_FACTOR(0)} as l, h * {_FACTOR(1)} * coalesce(0.7::double + 0.3::double * authority, 1) * case when ai > 0.5 and coverage < 0.5 then 0.7::double + 0.3::double * coverage else 1 end as h
 from (select cluster_index, sum(cur) as c, sum(low) as l, sum(high) as h, avg(case when ai then 1.0::double else 0 end) as ai from kb group by 1) a join rd using (cluster_index)) b""")
def full_bands(spark, sf):
    """Click bands adjusted by demand state, authority and coverage."""
    df, membership, ready, authority, coverage, state = _signals(spark, sf)
    return A.cluster_bands(A.keyword_bands(df.join(membership, "kw_idx"), ready), state, authority, coverage)


_NEAR = """nb as (select cluster_index, term, head, row_number() over (partition by cluster_index order by weight desc, term) as rank from hd join (select a as h, b as term, weight from ed union all select b, a, weight from ed) g on g.h = head),
fz as (select cluster_index, term, rank from nb where rank <= 3 union all select cluster_index, term, rank from ft where cluster_index not in (select cluster_index from nb))"""
_ALONG = f""" union all select cluster_index, 6, rank, concat(new, ' ', t[-1]) from (select cluster_index, rank, t, list_filter({M._TOK.replace('keyword', 'term')}, lambda x: not list_contains(t, x))[1] as new from (select *, {M._TOK.replace('keyword', 'head')} as t from nb where rank <= 3) c) d where new is not null),
fo_b as"""


@query(Q.chain(M._TERMS, M._SIB, M._DOCS.rstrip().rstrip(","), M._TERMS3, _NEAR, M._ASKED.replace("from ft join hd", "from fz join hd").replace("),\nfo_b as", _ALONG, 1)) + "select cluster_index, archetype, norm, rank from fo")
def graph_fan_out(spark, sf):
    """Sub-queries with the neighbours of heads that are entities."""
    df, entities = M.with_entities(engine(spark, sf))
    _, clusters, membership = with_clusters(df)
    edges = C.settle(E.graph(df, entities))
    ways = edges.select(F.col("a").alias("head"), F.col("b").alias("term"), "weight").unionByName(edges.select(F.col("b").alias("head"), F.col("a").alias("term"), "weight"))
    near = ways.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(F.col("weight").desc(), "term")))  # of at most 60 nodes
    docs = C.settle(membership.join(df.select("kw_idx", "keyword"), "kw_idx"))
    made = O.sub_queries(clusters, docs, near.select("head", "term", "rank"), year=M._YEAR)
    return made.select("cluster_index", "archetype", "norm", F.col("rank").cast("long").alias("rank"))


@query()
def whole_run(spark, sf):
    """One run of the engine with all five modules on leader clusters: a row for each cluster with what every slot says of it.

    SQL has the parts (leader clusters, and each module on parent topics), not their composition.
    """
    kw = B.keywords(spark, sf)
    run = pipeline.analyze(kw, CONFIG)
    norm = run.keywords.select(F.col("kw_idx").alias("l_partkey"), X.norm_key(F.col("keyword")).alias("norm_kw"))
    shipped = B.read(spark, sf, "lineitem").groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM").alias("period")).agg(F.sum("l_quantity").alias("q"))
    series = C.settle(shipped.join(norm, "l_partkey").groupBy("norm_kw", "period").agg(F.sum("q").cast("double").alias("value")))
    slots = pipeline.run_modules(run, series=series, year=M._YEAR).slots
    keepers = slots["gatekeepers"].groupBy("cluster_index").agg(F.count("*").alias("gatekeepers"))
    out = run.clusters.select("cluster_index", "head", "size", "volume_total", "dominant_intent")
    for part in (slots["authority"].select("cluster_index", "authority"), slots["coverage"].select("cluster_index", "coverage"), slots["state"].select("cluster_index", "state", "p_value"), slots["readiness"], slots["bands"], keepers):
        out = out.join(part, "cluster_index", "left")
    return out.withColumn("gatekeepers", F.coalesce("gatekeepers", F.lit(0)))
