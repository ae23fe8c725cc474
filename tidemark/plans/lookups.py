"""Queries of lookups, scalars, set operations and remaining aggregates, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import numeric as N
from ..functions import text as X
from ..operators import keywords as K
from ..sources import capture
from . import bindings as B
from . import sql as Q
from .catalog import CORE, clustered, engine, query
from .modules import _OBSERVED, _TOK, _cited, _snapshot_sql, _snapshots

_values = lambda rows: "(values " + ", ".join("(" + ", ".join(str(v) if isinstance(v, (int, float)) else Q.q(v) for v in r) + ")" for r in rows) + ")"


_SYN = "sy as (select * from " + _values([(k, n, s) for k, v in L.SYNONYMS.items() for n, s in enumerate(v)]) + " t(token, p, s))"


@query(Q.chain(_SYN, f"ht as (select cluster_index, unnest({_TOK.replace('keyword', 'head')}) as token from cl)") + "select cluster_index, token, s as synonym from ht join sy using (token)")
def head_synonyms(spark, sf):
    clusters = clustered(spark, sf, CORE)[1]
    tokens = clusters.select("cluster_index", F.explode(X.tokens(F.col("head"))).alias("token"))
    return tokens.join(F.broadcast(capture.synonyms(spark)), "token").select("cluster_index", "token", "synonym")


@query(Q.chain() + "select geo_label as routing, count(*) as n from ac group by 1")
def routing_histogram(spark, sf):
    return engine(spark, sf).groupBy(K.routing().alias("routing")).agg(F.count("*").alias("n"))


@query(Q.chain() + f"select array_to_string({_TOK}, ' ') as norm, max(volume) as volume from kw group by 1")
def volume_by_norm(spark, sf):
    return B.keywords(spark, sf).groupBy(X.norm_key(F.col("keyword")).alias("norm")).agg(F.max("volume").alias("volume"))


@query(Q.chain() + "select kw_idx, concat(keyword, '␟', coalesce(language, 'unknown')) as key from la")
def composite_keys(spark, sf):
    return K.language(B.keywords(spark, sf)).select("kw_idx", F.concat_ws("␟", "keyword", F.coalesce("language", F.lit("unknown"))).alias("key"))


@query(Q.chain() + "select kw_idx, feature, count(*) over (partition by feature) as n from (select kw_idx, unnest(serp_features) as feature from kw) b")
def feature_counts(spark, sf):
    rows = B.keywords(spark, sf).select("kw_idx", F.explode("serp_features").alias("feature"))
    return rows.join(F.broadcast(rows.groupBy("feature").agg(F.count("*").alias("n"))), "feature").select("kw_idx", "feature", "n")  # a row for each of a closed set of features


@query(Q.chain() + "select cluster_index, feature, n, r from (select cluster_index, feature, count(*) as n, row_number() over (partition by cluster_index order by count(*) desc, feature) as r from (select cluster_index, unnest(serp_features) as feature from mb join ac using (kw_idx)) b group by 1, 2) c where r <= 8")
def cluster_features(spark, sf):
    df, _, membership = clustered(spark, sf, CORE)
    counts = df.join(membership, "kw_idx").select("cluster_index", F.explode("serp_features").alias("feature")).groupBy("cluster_index", "feature").agg(F.count("*").alias("n"))
    order = Window.partitionBy("cluster_index").orderBy(F.col("n").desc(), "feature")
    return counts.withColumn("r", F.row_number().over(order).cast("long")).where("r <= 8")


@query(Q.chain() + "select cluster_index, array_to_string(list_sort(list(distinct keyword))[1:8], '|') as examples from mb join ac using (kw_idx) where question_paa <> 'neither' group by 1")
def question_examples(spark, sf):
    df, _, membership = clustered(spark, sf, CORE)
    return df.where("question_paa <> 'neither'").join(membership, "kw_idx").groupBy("cluster_index").agg(F.array_join(F.slice(F.array_sort(F.collect_set("keyword")), 1, 8), "|").alias("examples"))


@query(_snapshot_sql("select coalesce(b_intent, c_intent) as query_type, coalesce(bn, 0) as base, coalesce(cn, 0) as current, coalesce(cn, 0) - coalesce(bn, 0) as shift from (select bq as b_intent, count(*) as bn from pr where inb group by 1) x full join (select cq as c_intent, count(*) as cn from pr where inc group by 1) y on b_intent = c_intent"))
def label_shift(spark, sf):
    pairs = _snapshots(spark, sf)
    base = pairs.where("in_base").groupBy(F.col("b_quick_win").alias("query_type")).agg(F.count("*").alias("base"))
    current = pairs.where("in_current").groupBy(F.col("c_quick_win").alias("query_type")).agg(F.count("*").alias("current"))
    both = base.join(current, "query_type", "full_outer").select("query_type", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("current", F.lit(0)).alias("current"))
    return both.withColumn("shift", F.col("current") - F.col("base"))


@query("select domain, query, round(sum(weight / n::double), 6) as weight, grouping(query) as total from (select page_id % 40 as query, (page_id % 40) % 7 + 1 as weight, regexp_replace(regexp_extract(lower(url), '://([^/?#]*)', 1), '^www\\.', '') as domain, count(*) over (partition by page_id % 40) as n from pages) b group by grouping sets ((query, domain), (domain))")
def citation_grouping_sets(spark, sf):
    cited = _cited(spark, sf)
    each = cited.groupBy("query", "domain").agg(F.sum("weight").alias("weight"), F.count("*").alias("own"))  # a hot query arrives as one row a task and domain
    per = each.join(each.groupBy("query").agg(F.sum("own").alias("n")), "query")
    sets = per.groupingSets([[F.col("query"), F.col("domain")], [F.col("domain")]], F.col("query"), F.col("domain"))
    return sets.agg(F.round(F.sum(F.col("weight") / F.col("n")), 6).alias("weight"), F.grouping("query").cast("bigint").alias("total")).select("domain", "query", "weight", "total")


@query("select doc_id, nfc_normalize(text) as composed from documents")
def composed_lines(spark, sf):
    line = F.col("text")
    return B.read(spark, sf, "documents").select("doc_id", F.when(line.rlike(r"[^\x00-\x7F]"), X.nfc(line)).otherwise(line).alias("composed"))


@query("select o_orderkey, cast(substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 1, 4) as int) as year, strftime(o_orderdate, '%Y-%m') as period from orders")
def pinned_years(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return B.read(spark, sf, "orders").select("o_orderkey", F.substring(stamp, 1, 4).cast("int").alias("year"), F.date_format(F.to_timestamp(stamp, "yyyy-MM-dd'T'HH:mm:ssX"), "yyyy-MM").alias("period"))


@query("select o_orderpriority as norm_kw, m as period, cast(v as double) as value from (select o_orderpriority, " + ", ".join(f"count(*) filter (month(o_orderdate) = {k}) as m{k:02d}" for k in range(1, 13)) + " from orders group by 1) b unpivot (v for m in (" + ", ".join(f"m{k:02d}" for k in range(1, 13)) + "))")
def month_unpivot(spark, sf):
    months = [F.count_if(F.month("o_orderdate") == k).cast("double").alias(f"m{k:02d}") for k in range(1, 13)]
    wide = B.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("norm_kw")).agg(*months)
    return wide.unpivot("norm_kw", [f"m{k:02d}" for k in range(1, 13)], "period", "value")


@query("select l_orderkey, l_linenumber, round(least(100.0::double, 100 * log10(l_extendedprice) / log10(100000)), 6) as volume_score, cast(case when p = 1 then 100 when p <= 3 then 90 when p <= 10 then 80 - (p - 4) * 5 when p <= 20 then 50 - (p - 11) * 3 when p <= 50 then greatest(5, 25 - (p - 21) * 0.5::double) else 5 end as double) as position_score from (select *, cast(l_quantity as int) as p from lineitem where l_extendedprice > 0) b")
def normalizers(spark, sf):
    lines = B.read(spark, sf, "lineitem").where("l_extendedprice > 0")
    return lines.select("l_orderkey", "l_linenumber", F.round(N.volume_score(F.col("l_extendedprice")), 6).alias("volume_score"), N.position_score(F.col("l_quantity").cast("int")).cast("double").alias("position_score"))


@query(Q.chain(_OBSERVED) + "select count(*) as matched from ob where norm in (select norm from nk)")
def matched_queries(spark, sf):
    from .modules import _observed

    kw, observed = _observed(spark, sf)
    return observed.join(kw.select("norm").distinct(), "norm", "left_semi").agg(F.count("*").alias("matched"))


@query(_snapshot_sql("select keyword, cp - bp as change from pr where inb and inc and cp < bp order by 2, 1 limit 15"))
def climbers(spark, sf):
    pairs = _snapshots(spark, sf).where("in_base and in_current")
    return pairs.select("keyword", (F.col("c_position") - F.col("b_position")).alias("change")).where("change < 0").orderBy("change", "keyword").limit(15)


@query(Q.chain() + "select source, count(*) as n, array_to_string(list_sort(list(distinct language)), ',') as languages from la group by 1")
def sources_and_languages(spark, sf):
    return K.language(B.keywords(spark, sf)).groupBy("source").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
