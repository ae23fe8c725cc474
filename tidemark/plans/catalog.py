"""Registered queries over the bindings, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import numeric as N
from ..functions import text as X
from ..operators import clusters as C
from ..operators import keywords as K
from ..operators import summary as S
from . import bindings as B
from . import sql as Q

CONFIG = replace(K.Config(), client_domain=B.CLIENT, brands=("steel",))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def engine(spark: SparkSession, sf_dir: str, when: str | None = None) -> DataFrame:
    """The keyword corpus through enrichment, scopes and scores."""
    df = B.keywords(spark, sf_dir, when).withColumn("clustered", F.col("parent_topic").isNotNull())
    return K.scores(K.scopes(K.enrich(df, CONFIG), CONFIG), CONFIG)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_opportunity_score(spark, sf_dir)


CHAIN = Q.chain()

# ---------------------------------------------------------------- rows


@query(CHAIN + "select kw_idx, keyword, source, volume, difficulty, position, array_to_string(serp_features, '|') as features, parent_topic, competitor_url from kw")
def canonical_records(spark, sf):
    return B.keywords(spark, sf).select("kw_idx", "keyword", "source", "volume", "difficulty", "position", F.array_join("serp_features", "|").alias("features"), "parent_topic", "competitor_url")


@query(CHAIN + "select kw_idx, language, round(language_confidence::double, 4) as confidence from la")
def keyword_language(spark, sf):
    return K.language(B.keywords(spark, sf)).select("kw_idx", "language", F.round("language_confidence", 4).alias("confidence"))


@query(Q.texts() + "select doc_id, keyword, language, round(language_confidence::double, 4) as confidence from lt")
def text_language(spark, sf):
    return K.language(B.whole_texts(spark, sf)).select("doc_id", "keyword", "language", F.round("language_confidence", 4).alias("confidence"))


@query(Q.texts() + "select lang, language, count(*) as n from lt group by 1, 2")
def language_confusion(spark, sf):
    return K.language(B.whole_texts(spark, sf)).groupBy("lang", "language").agg(F.count("*").alias("n"))


@query(CHAIN + f"select kw_idx, query_type, round(intent_confidence, 4) as confidence, {Q.case('query_type', {k: Q.q(v) for k, v in L.FUNNEL.items()}, 'null')} as funnel_stage, modality, temporal from en")
def intent_vector(spark, sf):
    return K.enrich(B.keywords(spark, sf), CONFIG).select("kw_idx", "query_type", F.round("intent_confidence", 4).alias("confidence"), "funnel_stage", "modality", "temporal")


@query(CHAIN + "select query_type, count(*) as n, cast(sum(coalesce(volume, 0)) as bigint) as volume from en group by 1")
def intent_histogram(spark, sf):
    return K.enrich(B.keywords(spark, sf), CONFIG).groupBy("query_type").agg(F.count("*").alias("n"), F.sum(F.coalesce("volume", F.lit(0))).alias("volume"))


@query(CHAIN + "select kw_idx, branded, case when branded then 'steel' else '' end as brand_match, question_shape, round(least(1.0, asks)::double, 2) as question_confidence, token_count, length(keyword) as char_count, case when token_count <= 2 then 'head' when token_count <= 4 then 'mid' else 'long_tail' end as tail_class from sc")
def keyword_shape(spark, sf):
    return K.enrich(B.keywords(spark, sf), CONFIG).select("kw_idx", "branded", "brand_match", "question_shape", F.round("question_confidence", 2).alias("question_confidence"), F.col("token_count").cast("long"), F.col("char_count").cast("long"), "tail_class")


@query(CHAIN + "select kw_idx, aio_label, aio_score, round(case when shown then 1.0 else least(1.0, aio_score / 100.0 + 0.1) end, 4) as confidence from sc")
def aio_eligibility(spark, sf):
    return engine(spark, sf).select("kw_idx", "aio_label", F.col("aio_score").cast("long"), F.round("aio_confidence", 4).alias("confidence"))


@query(CHAIN + "select kw_idx, geo_label, geo_score, round(least(1.0, geo_score / 100.0 + 0.1), 4) as confidence from sc")
def geo_opportunity(spark, sf):
    return engine(spark, sf).select("kw_idx", "geo_label", F.col("geo_score").cast("long"), F.round("geo_confidence", 4).alias("confidence"))


@query(CHAIN + "select kw_idx, keyword, volume, difficulty, position, round(quick_win_confidence, 4) as confidence from sc where wins")
def quick_wins(spark, sf):
    return engine(spark, sf).where("quick_win = 'quick_win'").select("kw_idx", "keyword", "volume", "difficulty", "position", F.round("quick_win_confidence", 4).alias("confidence"))


@query(CHAIN + "select kw_idx, striking, position from sc where strikes")
def striking_distance(spark, sf):
    return engine(spark, sf).where("striking <> 'not_striking'").select("kw_idx", "striking", "position")


@query(CHAIN + "select kw_idx, question_paa, long_tail, seasonality, case when branded then 'branded' else 'non_branded' end as branded_label from sc")
def shape_scopes(spark, sf):
    return engine(spark, sf).select("kw_idx", "question_paa", "long_tail", "seasonality", "branded_label")


@query(CHAIN + "select kw_idx, score_main, confidence_main, cast(score_quick_win as double) as score_quick_win, score_strategic, score_aeo from so")
def composite_scores(spark, sf):
    return engine(spark, sf).select("kw_idx", "score_main", "confidence_main", "score_quick_win", "score_strategic", "score_aeo")


@query(CHAIN + "select kw_idx, action from ac")
def action_class(spark, sf):
    return engine(spark, sf).select("kw_idx", "action")


# ---------------------------------------------------------------- corpus


@query(CHAIN + """select count(*) as total_keywords, round(avg(a), 3) as aio_share, round(avg(g), 3) as geo_share, round(100 * (0.30 * avg(score_main) / 100 + 0.25 * avg(w) + 0.20 * avg(s) + 0.15 * avg(a) + 0.10 * avg(g)), 1) as demand_opportunity_score
 from (select score_main, case when aio_label in ('confirmed', 'eligible') then 1.0::double else 0 end as a, case when geo_label in ('dual', 'geo_only') then 1.0::double else 0 end as g, case when wins then 1.0::double else 0 end as w, case when strikes then 1.0::double else 0 end as s from ac) b""")
def demand_opportunity_score(spark, sf):
    return S.shares(engine(spark, sf))


@query(CHAIN + "select 'source' as dimension, source as value, count(*) as n from ac group by 2 union all select 'language', language, count(*) from ac group by 2 union all select 'intent', query_type, count(*) from ac group by 2")
def corpus_histograms(spark, sf):
    return S.histograms(engine(spark, sf))


_GAP = """gp as (select kw_idx, keyword, 'keyword_gap' as gap from ac where competitor_url <> '' and not contains(competitor_url, '{c}') and (position is null or position > 100)
 union all select kw_idx, keyword, 'aeo_geo_gap' from ac where aio_label in ('confirmed', 'eligible') and (position is null or position > 10))""".replace("{c}", B.CLIENT)


@query(Q.chain(_GAP) + "select gap, max(n) as n, string_agg(keyword, '|' order by kw_idx) as samples from (select *, count(*) over (partition by gap) as n, row_number() over (partition by gap order by kw_idx) as r from gp) b where r <= 20 group by gap")
def keyword_gaps(spark, sf):
    return S.gaps(engine(spark, sf), B.CLIENT)


@query(CHAIN + "select array_to_string(list_sort(list(distinct query_type)), ',') as intents from ac")
def content_intents(spark, sf):
    return engine(spark, sf).agg(F.array_join(F.array_sort(F.collect_set("query_type")), ",").alias("intents"))


_SHARE = " union all ".join(f"select {s} as share, (select score_main from (select score_main, row_number() over (order by score_main) as r, count(*) over () as n from ac) b where r = floor(n * {s}) + 1) as value" for s in ("0.5", "0.75", "0.9", "0.99"))


@query(Q.chain() + f"select cast(share as double) as share, value from ({_SHARE}) x")
def score_percentiles(spark, sf):
    return S.index_percentiles(engine(spark, sf), "score_main")


@query(CHAIN + "select a.action, count(k.action) as n from (values ('create'), ('update'), ('restructure'), ('monitor'), ('ignore')) a(action) left join ac k on k.action = a.action group by 1")
def action_histogram(spark, sf):
    return S.action_histogram(engine(spark, sf))


@query(CHAIN + "select kw_idx, keyword, score_main from ac order by score_main desc, kw_idx limit 20")
def top_main(spark, sf):
    return S.top(engine(spark, sf), "score_main")


@query(CHAIN + "select kw_idx, keyword, score_aeo from ac order by score_aeo desc, kw_idx limit 20")
def top_aeo(spark, sf):
    return S.top(engine(spark, sf), "score_aeo")


@query(CHAIN + "select query_type, cast(sum(coalesce(volume, 0)) as bigint) as volume, count(*) as n, grouping(query_type) as total from ac group by rollup (query_type)")
def intent_rollup(spark, sf):
    return engine(spark, sf).rollup("query_type").agg(F.sum(F.coalesce("volume", F.lit(0))).alias("volume"), F.count("*").alias("n"), F.grouping("query_type").cast("long").alias("total"))


# ---------------------------------------------------------------- clusters


#: What the modules read of a scored keyword.
CORE = ("kw_idx", "keyword", "language", "volume", "position", "serp_features", "parent_topic", "query_type", "aio_score", "geo_label", "question_paa", "question_shape")


def clustered(spark, sf, columns=None):
    """The scored corpus (all of it, or these columns), its clusters and membership, each stored once: every branch of a plan would compute them anew."""
    df = engine(spark, sf)
    return with_clusters(C.settle(df.select(*columns) if columns else df))


def with_clusters(df):
    clusters = C.settle(C.topic_clusters(df))
    return df, clusters, C.settle(C.topic_members(df, clusters))


@query(CHAIN + """select c.cluster_index, c.head, c.head_idx, c.parent_topic, c.size, c.volume_total, d.query_type as dominant_intent from cl c
 join (select cluster_index, query_type, row_number() over (partition by cluster_index order by count(*) desc, min(a.kw_idx)) as r from mb join ac a using (kw_idx) group by 1, 2) d on d.cluster_index = c.cluster_index and d.r = 1""")
def parent_clusters(spark, sf):
    df, clusters, membership = clustered(spark, sf)
    return C.describe(clusters, membership, df).select("cluster_index", "head", "head_idx", "parent_topic", "size", "volume_total", "dominant_intent")


@query(CHAIN + "select kw_idx, cluster_index from mb")
def cluster_membership(spark, sf):
    return clustered(spark, sf)[2]


def _stem_sql(c: str) -> str:
    """A stem of token t in language c: the first suffix that leaves three letters goes."""
    whens = " ".join(f"when ends_with(t, {Q.q(s)}) and len(t) - {len(s)} >= 3 then " + ("concat(t[:-4], 'y')" if (c, s) == ("en", "ies") else f"t[:-{len(s) + 1}]") for s in L.STEM_SUFFIXES[c])
    return f"list_sort(list_distinct(list_transform(list_filter(ws, lambda t: len(t) >= 3 and not list_contains({Q.array(L.STOP_WORDS[c])}, t)), lambda t: case when len(t) <= 3 then t {whens} else t end)))"


_NEAR = "len(list_intersect({0}, {1}))::double / greatest(len({0}), len({1}))".format
#: The rule as it is stated: sets are visited one by one; those without a head of enough overlap become heads.
_LEADERS = f"""lc as (select kw_idx, keyword, coalesce(volume, 0) as v, parent_topic, row_number() over (order by coalesce(volume, 0) desc, kw_idx) as place, {Q.by_lang(_stem_sql)} as s from la),
sh as (select cluster_index, s, 0 as place from cl join lc on kw_idx = head_idx where len(s) > 0),
nd as (select s, place, row_number() over (order by place) as step from (select s, min(place) as place from lc where parent_topic is null and len(s) > 0 group by 1) b),
vs as (select 0 as step, 0 as place, [0]::bigint[] as made, (select coalesce(list(s), []) from sh) as heads
 union all select nd.step, nd.place, case when far then list_append(made, nd.place) else made end, case when far then list_append(heads, s) else heads end
  from (select vs.made, vs.heads, nd.*, len(list_filter(vs.heads, lambda h: {_NEAR('h', 'nd.s')} >= 0.6::double)) = 0 as far from vs join nd on nd.step = vs.step + 1) nd),
nh as (select place, row_number() over (order by place) - 1 + (select count(*) from cl) as cluster_index from (select unnest(arg_max(made, step)[2:]) as place from vs) b),
ah as (select cluster_index, s, place from sh union all select cluster_index, s, place from nh join lc using (place)),
lm as (select kw_idx, arg_max(ah.cluster_index, struct_pack(o := {_NEAR('lc.s', 'ah.s')}, c := -ah.cluster_index)) as cluster_index from lc join ah on ah.place <= lc.place where parent_topic is null and {_NEAR('lc.s', 'ah.s')} >= 0.6::double group by 1)"""


@query(
    Q.chain(_LEADERS).replace("with kw", "with recursive kw", 1)
    + "select kw_idx, cluster_index, head, 0.95::double as confidence from mb join cl using (cluster_index) union all select lm.kw_idx, cluster_index, lc.keyword, case when nh.place is null then 0.95::double else 0.7::double end from lm left join nh using (cluster_index) left join cl using (cluster_index) join lc on lc.place = nh.place or lc.kw_idx = cl.head_idx"
)
def leader_clusters(spark, sf):
    """Both clustering passes, as rounds; the SQL and the tests visit keywords one by one."""
    df = K.language(B.keywords(spark, sf))
    clusters, membership = C.leader_clusters(df)
    return membership.join(clusters, "cluster_index").select("kw_idx", "cluster_index", "head", "confidence")


@query(CHAIN + "select cluster_index, head, volume_total from cl order by volume_total desc, cluster_index limit 12")
def top_clusters(spark, sf):
    df, clusters, membership = clustered(spark, sf)
    return C.describe(clusters, membership, df).orderBy(F.col("volume_total").desc(), "cluster_index").select("cluster_index", "head", "volume_total").limit(12)


@query(Q.texts() + "select doc_id, lang, array_to_string(case lang " + " ".join(f"when {Q.q(c)} then {_stem_sql(c)}" for c in L.LANGUAGES) + " end, ' ') as stems from lt")
def stems_of_texts(spark, sf):
    """Stems of whole texts by their own language, all four."""
    texts = B.whole_texts(spark, sf)
    return texts.select("doc_id", "lang", F.array_join(F.array_sort(F.array_distinct(X.stems(F.col("keyword"), F.col("lang")))), " ").alias("stems"))


# ---------------------------------------------------------------- scalars on driver tables


@query(r"select page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), '^www\.', '') as host from pages")
def page_domains(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", X.domain(F.col("url")).alias("host"))


@query(r"select doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: len(t) >= 2), ' ') as norm from documents")
def norm_keys(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", X.norm_key(F.col("text")).alias("norm"))


@query("select o_orderkey, try_cast(regexp_replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '[,.]', '', 'g') as bigint) as as_int, round(try_cast(cast(cast(o_totalprice as decimal(18,2)) as varchar) as double) / 100, 6) as as_share from orders")
def coercions(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return B.read(spark, sf, "orders").select("o_orderkey", X.coerce_int(price).alias("as_int"), F.round(X.coerce_float(F.concat(F.lit("$"), price, F.lit("%"))), 6).alias("as_share"))


@query("select l_orderkey, l_linenumber, least(100, cast(round(cast(l_discount as decimal(10,4)) * (case when max(l_discount) over () <= 1 then 100 else 1 end), 0) as int)) as difficulty from lineitem")
def difficulty_scale(spark, sf):
    lines = B.read(spark, sf, "lineitem")
    value = X.coerce_difficulty(F.col("l_discount").cast("decimal(10,4)").cast("string"))
    top = lines.agg(F.max("l_discount").alias("top"))
    return lines.crossJoin(F.broadcast(top)).select("l_orderkey", "l_linenumber", X.scaled_difficulty(value, F.col("top")).alias("difficulty"))  # one row of one number


@query("select s_suppkey, case when regexp_matches(c, '^[=+\\-@\\t\\r\\n]') then concat('''', c) else c end as cell from (select s_suppkey, concat(case s_suppkey % 4 when 0 then '=' when 1 then '@' when 2 then '-' else '' end, s_name) as c from supplier) b")
def safe_cells(spark, sf):
    k = F.col("s_suppkey")
    cell = F.concat(F.when(k % 4 == 0, "=").when(k % 4 == 1, "@").when(k % 4 == 2, "-").otherwise(""), F.col("s_name"))
    return B.read(spark, sf, "supplier").select("s_suppkey", X.safe_cell(cell).alias("cell"))


@query("select c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') as label, replace(replace(concat('<', c_mktsegment, '&>'), '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') as escaped from customer")
def labels_and_escapes(spark, sf):
    return B.read(spark, sf, "customer").select("c_custkey", X.label(F.col("c_name")).alias("label"), X.escape_html(F.concat(F.lit("<"), "c_mktsegment", F.lit("&>"))).alias("escaped"))


from . import modules, lookups, portfolio, extensions, composed  # noqa: E402, F401, I001  they register their queries
