"""Queries of the analysis modules and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import numeric as N
from ..functions import text as X
from ..operators import answers as A
from ..operators import clusters as C
from ..operators import compare as R
from ..operators import entities as E
from ..operators import fanout as O
from ..operators import italian as I
from ..operators import keywords as K
from ..operators import pulse as P
from . import bindings as B
from . import sql as Q
from .catalog import CONFIG, CORE, clustered, engine, query, with_clusters

# ---------------------------------------------------------------- entities

_STOPS = "case language " + " ".join(f"when {Q.q(c)} then {Q.array(L.ENTITY_STOPS[c])}" for c in ("en", "fr", "de", "es", "it")) + " end"
_TOK = r"list_filter(regexp_extract_all(lower(keyword), '[\p{L}\p{N}_]+'), lambda t: len(t) >= 2)"
_TERMS = f"""tk as (select kw_idx, {_TOK} as t, {_STOPS} as stop from ac),
ux as (select kw_idx, t, stop, unnest(range(1, len(t) + 1)) as i from tk),
tm as (select kw_idx, t[i] as term, i - 1 as first from ux where not list_contains(stop, t[i]) union all select kw_idx, concat(t[i], ' ', t[i + 1]), i - 1 from ux where i < len(t) and not list_contains(stop, t[i]) and not list_contains(stop, t[i + 1])),
ex_a as (select term, kw_idx, count(*) as tf, min(first) as first from tm group by 1, 2),
ex as (select term, cast(sum(tf) as bigint) as tf, count(*) as df, round(ln((select count(*) from ac)::double / count(*)), 6) as idf, round(sum(1.0::double / (1 + first)) / count(*), 6) as position_factor, round(sum(1.0::double / (1 + first)), 6) as score from ex_a group by 1 having count(*) >= 2),
sa_a as (select *, row_number() over (order by score desc, term) as rank from ex),
sa as (select s.rank, s.term, s.df, s.score, cast(sum(coalesce(a.volume, 0)) as bigint) as demand_volume, count(*) filter (a.position > 0 and a.position <= 20) as owned_support from sa_a s join ex_a x using (term) join ac a using (kw_idx) where s.rank <= 200 group by 1, 2, 3, 4),
ed as (select x.term as a, y.term as b, count(*) as weight from (select * from ex_a join sa using (term) where rank <= 60) x join (select * from ex_a join sa using (term) where rank <= 60) y on x.kw_idx = y.kw_idx and x.rank < y.rank group by 1, 2)"""
ENTITIES = Q.chain(_TERMS)


def with_entities(df):
    """The corpus with its terms, and its entities, each stored once."""
    df = C.settle(E.with_terms(df.select(*CORE)))
    return df, C.settle(E.salient(df))


def _entities(spark, sf):
    return with_entities(engine(spark, sf))


@query(ENTITIES + "select term, tf, df, idf, position_factor, score from ex")
def entity_extract(spark, sf):
    return E.extract(engine(spark, sf))


@query(ENTITIES + "select rank, term, df, score, demand_volume, owned_support, round(owned_support::double / df, 4) as ownership_ratio, owned_support > 0 as owned from sa")
def salient_entities(spark, sf):
    return _entities(spark, sf)[1].select(F.col("rank").cast("long"), "term", "df", "score", "demand_volume", "owned_support", "ownership_ratio", "owned")


@query(ENTITIES + "select a, b, weight from ed")
def entity_graph(spark, sf):
    return E.graph(*_entities(spark, sf))


@query(ENTITIES + "select term, cast(sum(weight) as bigint) as degree from (select a as term, weight from ed union all select b, weight from ed) u group by 1")
def entity_degrees(spark, sf):
    return E.degrees(E.graph(*_entities(spark, sf)))


_PHRASES = rf"""with tx as (select doc_id as kw_idx, text, lower(lang) as language from documents),
ss as (select kw_idx, case language {" ".join(f"when {Q.q(c)} then {Q.array(L.ENTITY_STOPS[c])}" for c in L.ENTITY_STOPS)} else {Q.array(sorted({w for ws in L.ENTITY_STOPS.values() for w in ws}))} end as stop, regexp_extract_all(text, '[^.!?
]+') as sl from tx),
su as (select kw_idx, stop, sl, unnest(range(len(sl))) as sentence from ss),
pa as (select kw_idx, sentence, stop, list_filter(regexp_extract_all(sl[sentence + 1], '[\p{{L}}\p{{N}}_]+'), lambda t: len(t) >= 2) as raw from su),
pt as (select *, list_transform(raw, lambda r: lower(r)) as t from pa where len(raw) > 0),
pu as (select kw_idx, sentence, stop, raw, t, unnest(range(1, len(t) + 1)) as i from pt),
ws as (select sentence, raw[i] as raw, t[i] as term, t[i - 1] as l, t[i + 1] as r, list_position(t, t[i]) = i as new, i > 1 as inn from pu where not list_contains(stop, t[i])),
wf as (select term, count(*) as tf, greatest(count(*) filter (inn and raw[1] <> lower(raw[1])), count(*) filter (upper(raw) = raw and lower(raw) <> raw)) as cased, median(sentence) as mid, count(*) filter (new) as spread from ws group by 1),
wl as (select term, count(distinct l) / count(l)::double as l from ws where l is not null group by 1),
wr as (select term, count(distinct r) / count(r)::double as r from ws where r is not null group by 1),
wt as (select avg(tf) + stddev_pop(tf) as usual, max(tf) as most, (select count(*) from pt) as sentences from wf),
wx as (select term, tf, cased, mid, spread, 1 + (coalesce(l, 0) + coalesce(r, 0)) * tf / most as related, usual, sentences from wf left join wl using (term) left join wr using (term), wt),
sc as (select term, related * ln(ln(3 + mid)) / (cased / (1 + ln(tf)) + (tf / usual + spread::double / sentences) / related) as s from wx),
ph as (select kw_idx, sentence, t[i] as term from pu where not list_contains(stop, t[i]) union all select kw_idx, sentence, concat(t[i], ' ', t[i + 1]) from pu where i < len(t) and not list_contains(stop, t[i]) and not list_contains(stop, t[i + 1])),
pf as (select term, count(*) as tf, count(distinct kw_idx) as df, median(sentence) as mid from ph group by 1 having count(distinct kw_idx) >= 2),
pw as (select term, unnest(string_split(term, ' ')) as word from pf),
pc as (select pw.term, sum(ln(s)) as product, sum(s) as total from pw join sc on sc.term = word group by 1),
pr as (select term, tf, df, round(ln((select count(*) from tx)::double / df), 6) as idf, round(ln(ln(3 + mid)), 6) as position_factor, round(ln(tf) + ln(1 + total) - product, 6) as score,
  array_to_string(list_sort(list_distinct(list_transform(string_split(term, ' '), lambda w: case when len(w) > 3 and w[-1] = 's' then w[:-2] else w end))), ' ') as signature from pf join pc using (term))
"""


@query(_PHRASES + "select term, tf, df, idf, position_factor, score from (select *, row_number() over (partition by signature order by score desc, term) as k from pr) b where k = 1")
def statistical_keyphrases(spark, sf):
    """The second extractor over whole texts."""
    docs = B.read(spark, sf, "documents")
    return E.extractor("statistical")(docs.select(F.col("doc_id").alias("kw_idx"), F.col("text").alias("keyword"), F.col("lang").alias("language")))


#: For gaps: keywords that hold these words have no rank, so that some entities are not owned.
UNRANKED = ("anvil", "rod")
_GAP_TERMS = _TERMS.replace("a.position > 0", "not regexp_matches(a.keyword, '" + "|".join(UNRANKED) + "') and a.position > 0")


def _gap_entities(spark, sf):
    df = engine(spark, sf)
    return with_entities(df.withColumn("position", F.when(~F.col("keyword").rlike("|".join(UNRANKED)), F.col("position"))))


@query(Q.chain(_GAP_TERMS) + "select term, demand_volume from sa where owned_support = 0 and demand_volume > 0 order by demand_volume desc, term limit 50")
def entity_gaps(spark, sf):
    return E.gaps(_gap_entities(spark, sf)[1])


_AUTHORITY = "au as (select cluster_index, cast(sum(demand_volume) as bigint) as weight, case when sum(demand_volume) > 0 then round(sum(case when owned_support > 0 then demand_volume else 0 end)::double / sum(demand_volume), 4) else 0 end as authority from (select distinct cluster_index, sa.term, demand_volume, owned_support from ex_a join sa using (term) join mb using (kw_idx)) d group by 1)"


@query(Q.chain(_TERMS, _AUTHORITY) + "select cluster_index, cast(authority as double) as authority, weight from au")
def topical_authority(spark, sf):
    df, entities = _entities(spark, sf)
    return E.authority(df, entities, C.parent_clusters(df)[1])


@query(Q.chain(_TERMS, _AUTHORITY) + "select row_number() over (order by weight desc, cluster_index) - 1 as place, cluster_index, cast(authority as double) as authority, weight from au")
def authority_order(spark, sf):
    """Clusters with entities, by weight."""
    df, entities = _entities(spark, sf)
    found = E.authority(df, entities, C.parent_clusters(df)[1])
    return E.in_order(found).select("place", "cluster_index", "authority", "weight")


# ---------------------------------------------------------------- trends

_MK = """pr as (select a.grp, sign(b.v - a.v) as s, (b.v - a.v) / (b.pos - a.pos) as slope from sr a join sr b on a.grp = b.grp and a.pos < b.pos),
ti as (select grp, sum(t * (t - 1) * (2 * t + 5)) as ties from (select grp, v, count(*) as t from sr group by 1, 2) x group by 1),
mk as (select n.grp, n.n, cast(p.s as bigint) as s, (n.n * (n.n - 1) * (2 * n.n + 5) - ties) / 18.0::double as var_s from (select grp, count(*) as n from sr group by 1) n join ti using (grp) join (select grp, sum(s) as s from pr group by 1) p using (grp)),
sl as (select grp, median(slope) as slope from pr group by 1)"""


_Z = "zs as (select *, case when var_s <= 0 then null when s > 0 then (s - 1) / sqrt(var_s) when s < 0 then (s + 1) / sqrt(var_s) else 0 end as z from mk)"
_TESTS = f"grp, n, s, round(var_s, 6) as var_s, round(z, 6) as z, round(case when z is not null then least(1.0::double, 2 * ({Q.norm_tail('abs(z)')})) end, 6) as p_value, round(s / (n * (n - 1) / 2.0::double), 6) as tau, case when s > 0 then 'up' when s < 0 then 'down' else 'flat' end as direction"


@query(Q.monthly(_MK, _Z) + f"select {_TESTS} from zs")
def mann_kendall(spark, sf):
    return P.mann_kendall(B.series(spark, sf))


_INTERCEPT = "ic as (select sr.grp, median(v - slope * pos) as intercept from sr join sl using (grp) group by 1)"


@query(Q.events_by("hour", _MK, _Z, _INTERCEPT) + f"select {_TESTS}, round(slope, 6) as slope, round(intercept, 6) as intercept from zs join sl using (grp) join ic using (grp)")
def hourly_trends(spark, sf):
    """Trend tests of series of hundreds of points, which take the inversion counts and the slope selection."""
    return P.states(B.event_series(spark, sf, "hour")).drop("momentum", "seasonal_strength", "state")


@query(Q.monthly(_MK) + "select sr.grp, round(any_value(slope), 6) as slope, round(median(v - slope * pos), 6) as intercept from sr join sl using (grp) group by 1")
def theil_sen(spark, sf):
    return P.theil_sen(B.series(spark, sf))


@query(Q.events_by("day", _MK, _Z, _INTERCEPT) + f"select {_TESTS}, round(slope, 6) as slope, round(intercept, 6) as intercept from zs join sl using (grp) join ic using (grp)".replace(", case when s > 0 then 'up' when s < 0 then 'down' else 'flat' end as direction", ""))
def stream_trends(spark, sf):
    """Daily trends of events that come as a stream, in four parts by time: the state after the last equals batch."""
    from ..streaming import trends as T

    return T.replay(B.read(spark, sf, "events"), "event_type", "value", "ts", "day", digits=2)


@query(Q.monthly() + "select grp, round(avg(v) filter (r <= 3) / avg(v) filter (r between 4 and 6) - 1, 6) as momentum from (select *, row_number() over (partition by grp order by pos desc) as r from sr) b group by 1")
def momentum(spark, sf):
    return P.momentum(B.series(spark, sf))


@query(Q.monthly(_MK) + """select grp, case when n < 8 then 'unknown' when abs(z) > 1.959963984540054 and slope > 0 then 'rising' when abs(z) > 1.959963984540054 and slope < 0 then 'declining' else 'flat' end as state
 from (select grp, n, case when s > 0 then (s - 1) / sqrt(var_s) when s < 0 then (s + 1) / sqrt(var_s) else 0 end as z, slope from mk join sl using (grp)) b""")
def demand_states(spark, sf):
    return P.states(B.series(spark, sf)).select("grp", "state")


@query("select grp, pos, v from (select e.event_type as grp, row_number() over (partition by e.event_type order by date_trunc('day', ts)) - 1 as pos, round(sum(value), 4) as v from events e group by e.event_type, date_trunc('day', ts)) b")
def cluster_series(spark, sf):
    events = B.read(spark, sf, "events").select("event_id", "event_type", "value", F.date_trunc("day", "ts").alias("period"))
    series = events.select(F.col("event_id").alias("kw_idx"), "period", "value")
    membership = events.select(F.col("event_id").alias("kw_idx"), F.col("event_type").alias("cluster_index"))
    return P.cluster_series(series, membership).select("grp", "pos", F.round("v", 4).alias("v"))


# ---------------------------------------------------------------- answers

_has = lambda *f: f"list_has_any(serp_features, {Q.array(f)})"
_SIGNALS = f"""sg as (select cluster_index, round(avg(least(1.0::double, aio_score / 100.0::double + case when geo_label in ('dual', 'geo_only') then 0.1 else 0 end)), 6) as eligibility,
 round(avg(case when question_paa <> 'neither' or question_shape or {_has('featured_snippet', 'paa', 'ai_overview')} then 1.0::double else 0 end), 6) as extractability,
 round(avg(case when {_has('featured_snippet', 'paa', 'shopping')} then 1.0::double else 0 end), 6) as structured_demand, cast(sum(coalesce(volume, 0)) as bigint) as demand from mb join ac using (kw_idx) group by 1)"""
_W = L.READINESS_WEIGHTS
_READY = f"""rd_a as (select sg.*, authority, {_W['eligibility']}::double + {_W['extractability']} + {_W['structured_demand']} + case when authority is null then 0 else {_W['entity_coverage']} end as tw from sg left join au using (cluster_index)),
rd as (select cluster_index, demand, round(100 * (eligibility * round({_W['eligibility']}::double / tw, 6) + coalesce(authority * round({_W['entity_coverage']}::double / tw, 6), 0) + extractability * round({_W['extractability']}::double / tw, 6) + structured_demand * round({_W['structured_demand']}::double / tw, 6)), 4) as readiness from rd_a)"""
ANSWERS = Q.chain(_TERMS, _AUTHORITY, _SIGNALS, _READY)


@query(Q.chain(_SIGNALS) + "select * from sg")
def cluster_signals(spark, sf):
    df, _, membership = clustered(spark, sf, CORE)
    return A.cluster_signals(df, membership)


def _ready(spark, sf):
    """Corpus, clusters, membership, authority and readiness, each computed once."""
    df, entities = _entities(spark, sf)
    _, clusters, membership = with_clusters(df)
    authority = C.settle(E.authority(df, entities, membership))
    return df, clusters, membership, authority, A.readiness(A.cluster_signals(df, membership), authority=authority)


@query(ANSWERS + "select cluster_index, readiness, round(100 * readiness * demand / sum(readiness * demand) over (), 4) as expected_share from rd")
def citation_readiness(spark, sf):
    return _ready(spark, sf)[4]


_ctr = lambda rank: "list_extract([" + ", ".join(f"{v}::double" for v in L.CTR.values()) + f"], greatest(1, least({rank}, 20)))"
_supp = "least(1.0::double, " + ", ".join(f"case when list_contains(serp_features, '{k}') then {v}::double else 1 end" for k, v in L.CLICK_FACTORS.items()) + ")"
_rate = lambda rank, recovery: f"({_ctr(rank)} * {_supp} * case when list_contains(serp_features, 'ai_overview') then {L.AI_MULTIPLIER}::double * (1 + {recovery} * 0.35::double) else 1 end)"
_BANDS = f"""kb_a as (select kw_idx, mb.cluster_index, volume, position, list_contains(serp_features, 'ai_overview') as ai, case when position is null then 'unranked' when position in (1, 2, 3, 10) then 'confirmed' when position <= 10 then 'interpolated' else 'extrapolated' end as provenance,
 case when position is null then 0 else volume * {_rate('position', '0')} end as cur, volume * {_rate('1', 'least(1.0::double, coalesce(readiness, 0) / 100)')} as h, volume * {_rate('greatest(1, least(3, coalesce(position, 3)))', '0')} as l
 from mb join ac using (kw_idx) left join rd on rd.cluster_index = mb.cluster_index where volume > 0),
kb as (select *, least(greatest(0, l - cur), greatest(0, h - cur)) * (1 - u) as low, greatest(greatest(0, l - cur), greatest(0, h - cur)) * (1 + u) as high from (select *, cast({Q.case('provenance', L.UNCERTAINTY, 0)} as double) as u from kb_a) b)"""


@query(Q.chain(_TERMS, _AUTHORITY, _SIGNALS, _READY, _BANDS) + "select kw_idx, cluster_index, provenance, round(cur + 3e-9, 4) as current, round(low + 3e-9, 4) as low, round(high + 3e-9, 4) as high from kb")
def keyword_bands(spark, sf):
    df, _, membership, _, ready = _ready(spark, sf)
    return A.keyword_bands(df.join(membership, "kw_idx"), ready).select("kw_idx", "cluster_index", "provenance", F.round(F.col("current") + 3e-9, 4).alias("current"), F.round(F.col("low") + 3e-9, 4).alias("low"), F.round(F.col("high") + 3e-9, 4).alias("high"))


@query(Q.chain(_TERMS, _AUTHORITY, _SIGNALS, _READY, _BANDS) + """select cluster_index, cast(round_even(c, 0) as bigint) as current_clicks, cast(round_even(least(l, h), 0) as bigint) as winnable_low, cast(round_even(greatest(l, h), 0) as bigint) as winnable_high, cast(round_even(c + least(l, h), 0) as bigint) as ceiling_low, cast(round_even(c + greatest(l, h), 0) as bigint) as ceiling_high, round(ai, 4) as ai_share
 from (select kb.cluster_index, sum(cur) as c, sum(low) as l, sum(high) * coalesce(0.7::double + 0.3::double * max(authority), 1) as h, avg(case when ai then 1.0::double else 0 end) as ai from kb left join au using (cluster_index) group by 1) b""")
def cluster_bands(spark, sf):
    df, _, membership, authority, ready = _ready(spark, sf)
    return A.cluster_bands(A.keyword_bands(df.join(membership, "kw_idx"), ready), authority=authority)


@query(Q.chain(_TERMS, _AUTHORITY, _SIGNALS, _READY, _BANDS) + "select query_type, round(sum(low), 3) as low, round(sum(high), 3) as high from kb join ac using (kw_idx) group by rollup (query_type)")
def intent_bands(spark, sf):
    df, _, membership, _, ready = _ready(spark, sf)
    bands = A.keyword_bands(df.join(membership, "kw_idx"), ready).join(df.select("kw_idx", "query_type"), "kw_idx")
    return bands.rollup("query_type").agg(F.round(F.sum("low"), 3).alias("low"), F.round(F.sum("high"), 3).alias("high"))


@query(f"select l_linenumber, l_quantity, round({_ctr('cast(l_quantity as int)')}, 6) as ctr, case when cast(l_quantity as int) in (1, 2, 3, 10) then 'confirmed' when l_quantity <= 10 then 'interpolated' else 'extrapolated' end as provenance, count(*) as n from lineitem group by 1, 2, 3, 4")
def ctr_lookup(spark, sf):
    rank = F.col("l_quantity").cast("int")
    return B.read(spark, sf, "lineitem").groupBy("l_linenumber", "l_quantity").agg(F.count("*").alias("n")).select("l_linenumber", "l_quantity", F.round(N.ctr(rank), 6).alias("ctr"), N.ctr_provenance(rank).alias("provenance"), "n")


_HOST = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.', '')"
_CITED = f"ct as (select page_id % 40 as query, (page_id % 40) % 7 + 1 as weight, {_HOST} as domain from pages), cs as (select domain, round(sum(weight / n::double), 6) as weight, round(100 * sum(weight / n::double) / sum(sum(weight / n::double)) over (), 4) as share from ct join (select query, count(*) as n from ct group by 1) c using (query) group by 1)"


def _cited(spark, sf):
    q = F.col("page_id") % 40
    return B.read(spark, sf, "pages").select(q.alias("query"), (q % 7 + 1).alias("weight"), X.domain(F.col("url")).alias("domain"))


@query("with " + _CITED + " select * from cs")
def citation_shares(spark, sf):
    return A.citation_shares(_cited(spark, sf))


@query("with " + _CITED + " select case when r <= 8 then domain else 'other' end as domain, round(sum(share), 4) as share from (select *, row_number() over (order by share desc, domain) as r from cs) b group by 1")
def competitor_split(spark, sf):
    return A.competitor_split(A.citation_shares(_cited(spark, sf)))


@query("select page_id, h = 'example.com' or ends_with(h, '.example.com') as client from (select page_id, " + _HOST + " as h from pages) b")
def client_pages(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", X.same_site(X.domain(F.col("url")), "example.com").alias("client"))


_NORM = f"array_to_string({_TOK}, ' ')"
_OBSERVED = f"nk as (select {_NORM} as norm, min(kw_idx) as kw_idx from kw group by 1), ob as (select {_NORM} as norm, clicks, impressions, position from kw union all select array_to_string(" + _TOK.replace("keyword", "s_name") + ", ' '), s_suppkey % 23, s_suppkey % 997, cast(null as int) from supplier)"


def _observed(spark, sf):
    kw = B.keywords(spark, sf).withColumn("norm", X.norm_key(F.col("keyword")))
    strange = B.read(spark, sf, "supplier").select(X.norm_key(F.col("s_name")).alias("norm"), (F.col("s_suppkey") % 23).alias("clicks"), (F.col("s_suppkey") % 997).alias("impressions"), F.lit(None).cast("int").alias("position"))
    return kw, kw.select("norm", "clicks", "impressions", "position").unionByName(strange)


@query(Q.chain(_OBSERVED) + "select cluster_index, cast(sum(clicks) as bigint) as clicks, count(*) as matched, round(sum(position * impressions) filter (impressions > 0 and position is not null)::double / sum(impressions) filter (impressions > 0 and position is not null), 2) as mean_position from ob join nk using (norm) join mb using (kw_idx) group by 1")
def observed_clicks(spark, sf):
    kw, observed = _observed(spark, sf)
    return A.observed_clicks(observed, kw, C.parent_clusters(kw)[1])


@query(Q.chain(_OBSERVED) + "select distinct norm from ob where norm not in (select norm from nk)")
def unmatched_queries(spark, sf):
    kw, observed = _observed(spark, sf)
    return A.unmatched(observed, kw)


# ---------------------------------------------------------------- fan-out

_SIB = f"""hd as (select cluster_index, head, list_distinct({_TOK.replace('keyword', 'head')}) as t from cl), hx as (select cluster_index, head, len(t) as n, unnest(t) as token from hd),
sb_a as (select a.cluster_index, b.head as sibling, b.cluster_index as other, count(*)::double / (a.n + b.n - count(*)) as jaccard from hx a join hx b on a.token = b.token and a.cluster_index <> b.cluster_index group by a.cluster_index, b.head, b.cluster_index, a.n, b.n),
sb as (select *, row_number() over (partition by cluster_index order by jaccard desc, sibling, other) as rank from sb_a where jaccard < 1)"""


@query(Q.chain(_SIB) + "select cluster_index, sibling, round(jaccard, 6) as jaccard, rank from sb where rank <= 3")
def sibling_heads(spark, sf):
    return O.siblings(clustered(spark, sf, CORE)[1]).select("cluster_index", "sibling", F.round("jaccard", 6).alias("jaccard"), F.col("rank").cast("long"))


_BM = f"""dc as (select cluster_index, kw_idx, {_TOK} as t from mb join ac using (kw_idx)), ds as (select cluster_index, count(*) as n, avg(len(t)) as avgdl from dc group by 1),
po as (select cluster_index, kw_idx, dl, term, count(*) as tf from (select cluster_index, kw_idx, len(t) as dl, unnest(t) as term from dc) x group by 1, 2, 3, 4), pf as (select cluster_index, term, count(*) as df from po group by 1, 2),
bq as (select cluster_index, concat(w, ' ', head) as query from cl, (values ('what'), ('why'), ('how'), ('when')) x(w)), bt as (select cluster_index, query, term, count(*) as qf from (select cluster_index, query, unnest({_TOK.replace('keyword', 'query')}) as term from bq) x group by 1, 2, 3),
bs as (select cluster_index, query, kw_idx as doc, sum(qf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))) as score from bt join po using (cluster_index, term) join pf using (cluster_index, term) join ds using (cluster_index) group by 1, 2, 3)"""


def _implicit(spark, sf):
    return _asked(*clustered(spark, sf, CORE))


def _asked(df, clusters, membership):
    """Implicit questions of the heads, and the members' keywords, which are stored: BM25 reads them for lengths, postings and document counts."""
    queries = clusters.select("cluster_index", F.explode(F.array(*(F.concat(F.lit(w + " "), "head") for w in ("what", "why", "how", "when")))).alias("query"))
    return queries.select("cluster_index", "query", X.norm_key(F.col("query")).alias("norm"), F.lit("implicit").alias("archetype")), C.settle(membership.join(df.select("kw_idx", "keyword"), "kw_idx"))


@query(Q.chain(_BM) + "select cluster_index, query, doc, round(score, 6) as score from bs")
def bm25_scores(spark, sf):
    queries, docs = _implicit(spark, sf)
    return O.bm25(queries, docs).select("cluster_index", "query", "doc", F.round("score", 6).alias("score"))


@query(Q.chain(_BM) + """select cluster_index, any_value(tau) as tau, round(avg(case when m >= tau and m > 0 then 1.0::double else 0 end), 4) as coverage, case when count(*) filter (m >= tau and m > 0) = 0 then 'implicit' else '' end as missing
 from (select *, round(median(m) over (partition by cluster_index), 6) as tau from (select bq.cluster_index, bq.query, round(coalesce(max(score), 0), 6) as m from bq left join bs using (cluster_index, query) group by 1, 2) x) y group by 1""")
def query_coverage(spark, sf):
    queries, docs = _implicit(spark, sf)
    return O.coverage(queries, O.bm25(queries, docs))[1]


_TERMS3 = f"""ft_a as (select cluster_index, kw_idx, unnest(t) as term, unnest(range(len(t))) as p from dc), ft_b as (select cluster_index, term, count(*) as n, min(kw_idx * 1000 + p) as first from ft_a group by 1, 2),
ft as (select *, row_number() over (partition by cluster_index order by n desc, first) as rank from ft_b where not exists (select 1 from hx where hx.cluster_index = ft_b.cluster_index and hx.token = ft_b.term))"""


@query(Q.chain(_SIB, _BM, _TERMS3) + "select cluster_index, term, rank from ft where rank <= 3")
def frequent_member_terms(spark, sf):
    df, clusters, membership = clustered(spark, sf, CORE)
    return O.frequent_terms(membership.join(df.select("kw_idx", "keyword"), "kw_idx"), clusters).select("cluster_index", "term", F.col("rank").cast("long"))


_YEAR = 2026
_SWAPS = ", ".join(f"({Q.q(w)}, {k}, {Q.q(o)})" for w, others in L.SYNONYMS.items() for k, o in enumerate(others))
_ASKED = f"""fo_a as (select cluster_index, 0 as a, rank as pos, concat(head, ' ', term) as text from ft join hd using (cluster_index) where rank <= 3
 union all select cluster_index, 1, p, concat(w, ' ', head) from hd, (values (0, 'what'), (1, 'why'), (2, 'how'), (3, 'when')) x(p, w)
 union all select cluster_index, 2, rank, concat(head, ' vs ', sibling) from sb join hd using (cluster_index) where rank <= 3
 union all select cluster_index, 3, p, concat(head, ' ', y) from hd, (values (0, {_YEAR}), (1, {_YEAR + 1}), (2, {_YEAR - 1})) x(p, y)
 union all select cluster_index, 5, (i - 1) * 100 + k, array_to_string(list_transform(t, lambda x, j: case when j = i then s else x end), ' ')
  from (select cluster_index, t, unnest(range(1, len(t) + 1)) as i from (select cluster_index, {_TOK.replace('keyword', 'head')} as t from cl) b) c join (values {_SWAPS}) x(w, k, s) on w = t[i]),
fo_b as (select f.cluster_index, a, pos, {_NORM.replace('keyword', 'text')} as norm, {_NORM.replace('keyword', 'head')} as own from fo_a f join hd using (cluster_index)),
fo_c as (select cluster_index, norm, min(a * 1000000 + pos) as place from fo_b where norm <> '' and norm <> own group by 1, 2),
fo_d as (select cluster_index, norm, place // 1000000 as a, row_number() over (partition by cluster_index, place // 1000000 order by place) as turn from fo_c),
fo as (select cluster_index, norm, [{", ".join(map(Q.q, O.ARCHETYPES))}][a + 1] as archetype, row_number() over (partition by cluster_index order by turn, a) as rank from fo_d qualify rank <= {O.MOST})"""
_DOCS, _SCORED = _BM.split("\nbq as (", 1)
_SCORED = "bq as (select cluster_index, norm as query from fo), " + _SCORED[_SCORED.index("bt as (") :]
_FAN = f"""fq_a as (select fo.cluster_index, norm as query, archetype, round(coalesce(max(score), 0), 6) as max_bm25 from fo left join bs on bs.cluster_index = fo.cluster_index and bs.query = norm group by all),
fq_b as (select *, round(median(max_bm25) over (partition by cluster_index), 6) as tau from fq_a),
fq as (select b.cluster_index, b.query, any_value(archetype) as archetype, any_value(max_bm25) as max_bm25, count(*) filter (tau > 0 and score >= tau) as centrality, any_value(max_bm25 >= tau and max_bm25 > 0) as covered from fq_b b left join bs on bs.cluster_index = b.cluster_index and bs.query = b.query group by 1, 2)"""
_FAN_OUT = Q.chain(_SIB, _DOCS.rstrip().rstrip(","), _TERMS3, _ASKED, _SCORED, _FAN)


def _fan_out(spark, sf):
    df, clusters, membership = clustered(spark, sf, CORE)
    docs = C.settle(membership.join(df.select("kw_idx", "keyword"), "kw_idx"))
    made = C.settle(O.sub_queries(clusters, docs, year=_YEAR))
    queries = made.select("cluster_index", F.col("norm").alias("query"), "norm", "archetype")
    return df, O.coverage(queries, O.bm25(queries, docs))[0]


@query(_FAN_OUT + "select * from fq")
def fan_out(spark, sf):
    """Generated sub-queries with their coverage."""
    return _fan_out(spark, sf)[1]


@query(_FAN_OUT + f"select cluster_index, query, centrality from fq where centrality >= 2 and query not in (select {_NORM} from ac where volume > 0)")
def gatekeepers(spark, sf):
    """Central sub-queries that no keyword with demand targets."""
    df, covered = _fan_out(spark, sf)
    return O.gatekeepers(covered, df.select(X.norm_key(F.col("keyword")).alias("norm"), "volume"))


# ---------------------------------------------------------------- comparison and audit

_EARLY, _LATE = "l_shipdate < timestamp '1998-07-01 00:00:00'", "l_shipdate >= timestamp '1998-07-01 00:00:00'"


def _snapshots(spark, sf):
    fields = ["quick_win", "position", "volume", "score_main", "score_aeo"]
    return R.paired(R.representatives(engine(spark, sf, _EARLY)), R.representatives(engine(spark, sf, _LATE)), fields)


def _snapshot_sql(final: str) -> str:
    run = lambda name, when: f"{name} as (select keyword, arg_min(quick_win, o) as quick_win, arg_min(position, o) filter (true) as pos_, arg_min(struct_pack(p := position, v := volume, m := score_main, a := score_aeo), o) as r from (select *, row_number() over (partition by keyword order by coalesce(volume, 0) desc, source, kw_idx) as o from ({Q.chain().replace('with kw as', 'with kw as').strip()} select * from ac) z) y where o = 1 group by 1)".replace("from lineitem where true", f"from lineitem where {when}")
    return f"with {run('b', _EARLY)}, {run('c', _LATE)}, pr as (select keyword, b.quick_win as bq, c.quick_win as cq, b.r.p as bp, c.r.p as cp, b.r.m as bm, c.r.m as cm, b.r.a as ba, c.r.a as ca, b.keyword is not null as inb, c.keyword is not null as inc from b full join c using (keyword)) {final}"


@query(_snapshot_sql("select keyword, case when cq = 'quick_win' and bq = 'quick_win' then 'still' when cq = 'quick_win' then 'newly' when cp <= 3 then 'captured' when cp < bp then 'still_climbing' when cp > bp then 'regressed' else 'reclassified' end as movement from pr where bq = 'quick_win' or cq = 'quick_win'"))
def quick_win_movement(spark, sf):
    return _snapshots(spark, sf).select("keyword", R.resolution().alias("movement")).where("movement is not null")


@query(_snapshot_sql("select count(*) as shared, round(avg(cm - bm), 2) as delta_score_main, round(avg(ca - ba), 2) as delta_score_aeo from pr where inb and inc"))
def score_deltas(spark, sf):
    return R.score_deltas(_snapshots(spark, sf), ["score_main", "score_aeo"])


@query(_snapshot_sql("select keyword, round(cm - bm, 1) as delta from pr where round(cm - bm, 1) > 0 order by 2 desc, 1 limit 15"))
def risers(spark, sf):
    return R.movers(_snapshots(spark, sf), "score_main", True)


@query(_snapshot_sql("select keyword, round(cm - bm, 1) as delta from pr where round(cm - bm, 1) < 0 order by 2, 1 limit 15"))
def fallers(spark, sf):
    return R.movers(_snapshots(spark, sf), "score_main", False)


_BEFORE = "o_orderdate < timestamp '1998-01-01 00:00:00'"
_CHANGED = f"ch as (select coalesce(a, b) as o_custkey, a is null as added, b is null as dropped from (select distinct o_custkey as a from orders where {_BEFORE}) x full join (select distinct o_custkey as b from orders where not ({_BEFORE})) y on a = b where a is null or b is null)"


def _changes(spark, sf):
    """Customers of two runs that share the orders between them."""
    orders = B.read(spark, sf, "orders")
    return R.changes(orders.where(_BEFORE), orders.where(f"not ({_BEFORE})"), "o_custkey")


@query(f"with {_CHANGED} select * from ch")
def key_changes(spark, sf):
    return _changes(spark, sf)


@query(f"with {_CHANGED} select change, o_custkey, rank::int as rank from (select case when added then 'added' else 'dropped' end as change, o_custkey, row_number() over (partition by added order by o_custkey) as rank from ch) b where rank <= 20")
def membership_samples(spark, sf):
    """The first keys that opened and closed, in order."""
    return R.samples(_changes(spark, sf), "o_custkey").select("change", "o_custkey", "rank")


_AUDIT = "select count(*) as total, 0::bigint as empty, 0::bigint as too_long, count(*) filter (volume < 0) as negative_volume, count(*) filter (difficulty < 0 or difficulty > 100) as bad_difficulty, count(*) filter (position < 1 or position > 100) as bad_position, (select cast(sum(n - 1) as bigint) from (select count(*) as n from kw group by keyword) b) as duplicates from kw"


@query(Q.chain() + _AUDIT)
def audit_rows(spark, sf):
    return R.audit_rows(B.keywords(spark, sf))


@query(Q.chain() + f"select 'WARNING' as severity, 'many_duplicates' as category, duplicates as n from ({_AUDIT}) a where duplicates::double / total > 0.05")
def audit_findings(spark, sf):
    return R.findings(R.audit_rows(B.keywords(spark, sf)))


@query("select source, round(n::double / t, 4) as share from (select case when l_quantity <= 2 then 'small' else 'large' end as source, count(*) as n, sum(count(*)) over () as t from lineitem group by 1) b where n > 0.9 * t")
def source_concentration(spark, sf):
    return R.source_concentration(B.read(spark, sf, "lineitem").select(F.when(F.col("l_quantity") <= 2, "small").otherwise("large").alias("source")))


# ---------------------------------------------------------------- language correction

_IT = f"""iv as (select *, len(list_filter(ws, lambda t: list_contains({Q.array(sorted({*L.IT_CUES, *L.IT_PRONOUNS}))}, t))) + case when regexp_matches(keyword, '[{L.IT_DIACRITICS}]') then 2 else 0 end as it_score,
 case when language_confidence < 0.5 then 0 else cast(round_even((language_confidence - 0.5) / 0.15, 0) as int) end as engine_score from lt)"""


@query(Q.texts(_IT) + "select doc_id, it_score, engine_score from iv")
def italian_votes(spark, sf):
    return I.votes(K.language(B.whole_texts(spark, sf))).select("doc_id", F.col("it_score").cast("long"), F.col("engine_score").cast("int"))


@query(Q.texts(_IT) + "select italian, engine, bearing, share, bearing >= 10 and share >= 0.5 as prior from (select count(*) filter (it_score >= 1) as italian, count(*) filter (language_confidence >= 0.65) as engine, count(*) filter (it_score >= 1 or language_confidence >= 0.65) as bearing, round(count(*) filter (it_score >= 1)::double / count(*) filter (it_score >= 1 or language_confidence >= 0.65), 4) as share from iv) b")
def italian_evidence(spark, sf):
    return I.evidence(I.votes(K.language(B.whole_texts(spark, sf))))


_MORPHOLOGY = f"len(list_filter(ws, lambda t: not regexp_matches(t, '[{L.IT_FOREIGN_LETTERS}]') and regexp_matches(t, '.{{2}}({'|'.join(L.IT_SUFFIXES)})$'))) > 0"
_SHAPE = f"(len(list_filter(ws, lambda t: not regexp_full_match(t, '[0-9]+'))) > 0 and len(list_filter(ws, lambda t: not regexp_full_match(t, '[0-9]+') and (regexp_matches(t, '[{L.IT_FOREIGN_LETTERS}]|oo') or not regexp_matches(t, '[{L.IT_VOWELS}]$')))) = 0)"


@query(Q.texts() + f"select doc_id, {_MORPHOLOGY} as morphology, {_SHAPE} as shape from lt")
def italian_forms(spark, sf):
    df = B.whole_texts(spark, sf)
    return df.select("doc_id", I.morphology(F.col("keyword")).alias("morphology"), I.shape(F.col("keyword")).alias("shape"))


_REASON = f"""pp as (select count(*) filter (it_score >= 1 or language_confidence >= 0.65) >= 10 and round(count(*) filter (it_score >= 1)::double / count(*) filter (it_score >= 1 or language_confidence >= 0.65), 4) >= 0.5 as prior from iv),
ir as (select iv.*, case when language_confidence >= 1 then null when it_score > engine_score then 'vote' when prior and it_score >= 1 and it_score = engine_score then 'tie_break'
 when prior and it_score = 0 and engine_score = 0 and {_MORPHOLOGY} then 'morphology' when prior and it_score = 0 and engine_score = 0 and {_SHAPE} then 'shape' end as reason from iv, pp)"""


@query(Q.texts(_IT, _REASON) + "select doc_id, case when reason is not null then 'it' else language end as language, case when reason = 'vote' then round(least(1.0, 0.5 + 0.15 * it_score)::double, 4) when reason is not null then 0.55 else round(language_confidence::double, 4) end as confidence from ir")
def corrected_language(spark, sf):
    df = K.language(B.whole_texts(spark, sf)).withColumns({"serp_features": F.array().cast("array<string>"), "query_type": F.lit("informational")})
    return I.correct(df).select("doc_id", "language", F.round("language_confidence", 4).alias("confidence"))


# ---------------------------------------------------------------- view


@query(ANSWERS + "select c.cluster_index, c.head, c.size, c.volume_total, round(a.authority, 4) as authority, r.readiness from cl c left join au a using (cluster_index) left join rd r using (cluster_index) order by c.volume_total desc, c.cluster_index limit 12")
def cluster_view(spark, sf):
    df, clusters, membership, authority, ready = _ready(spark, sf)
    clusters = C.describe(clusters, membership, df)
    view = clusters.join(authority.select("cluster_index", "authority"), "cluster_index", "left").join(ready, "cluster_index", "left")
    return view.orderBy(F.col("volume_total").desc(), "cluster_index").select("cluster_index", "head", "size", "volume_total", F.round("authority", 4).alias("authority"), "readiness").limit(12)


@query(Q.chain() + "select cluster_index, kw_idx, keyword, r from (select cluster_index, kw_idx, keyword, row_number() over (partition by cluster_index order by coalesce(volume, 0) desc, kw_idx) as r from mb join ac using (kw_idx)) b where r <= 5")
def content_briefs(spark, sf):
    df, _, membership = clustered(spark, sf, CORE)
    order = Window.partitionBy("cluster_index").orderBy(F.coalesce("volume", F.lit(0)).desc(), "kw_idx")
    return membership.join(df.select("kw_idx", "keyword", "volume"), "kw_idx").withColumn("r", F.row_number().over(order).cast("long")).where("r <= 5").select("cluster_index", "kw_idx", "keyword", "r")


@query(Q.chain() + "select kw_idx, keyword, array_to_string(serp_features, ',') as features, case when question_shape then 'yes' else '' end as question, score_main, action from ac order by score_main desc, kw_idx")
def enriched_rows(spark, sf):
    df = engine(spark, sf)
    return df.orderBy(F.col("score_main").desc(), "kw_idx").select("kw_idx", "keyword", F.array_join("serp_features", ",").alias("features"), F.when(F.col("question_shape"), "yes").otherwise("").alias("question"), "score_main", "action")
