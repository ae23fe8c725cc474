"""Corpora derived from the driver's tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

PREFIXES = ("best ", "buy ", "how to choose ", "what is the best ", "support for ", "", "cheap ")
SOURCES = ("gsc", "semrush", "ahrefs", "moz", "ubersuggest", "generic")
FEATURES = ("ai_overview", "paa", "featured_snippet,paa", "shopping", "local_pack")
RAW_FEATURES = ("AI Overview", "People Also Ask", "Featured snippet, PAA", "Shopping", "Local Pack")
CLIENT = "client.example"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(key, values, other):
    out = F.lit(other)
    for k, v in reversed(list(enumerate(values))):
        out = F.when(key == k, v).otherwise(out)
    return out


def keywords(spark: SparkSession, sf_dir: str, when: str | None = None) -> DataFrame:
    """Keyword corpus in canonical form; `when` restricts the demand to shipments that meet it.

    Its rows are few bytes and much work, and Spark cuts tasks by bytes: a million keywords would be one task's. They are
    therefore dealt over all of the session's shuffle partitions, by more than the join's key: Spark would leave out a
    shuffle by that key alone, and merge the join's partitions.
    """
    lines = read(spark, sf_dir, "lineitem")
    if when:
        lines = lines.where(when)
    demand = lines.groupBy("l_partkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    k = F.col("p_partkey")
    base = read(spark, sf_dir, "part").join(demand, F.col("l_partkey") == k, "left").select("p_partkey", F.lower("p_name").alias("nm"), F.coalesce("q", F.lit(0)).alias("q"))
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k, "nm")
    keyword = F.concat(_pick(k % 8, PREFIXES, "vs "), F.col("nm"))
    url = F.when(k % 3 == 0, F.concat(F.lit(f"https://www.{CLIENT}/p"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("https://rival.example/p"), k.cast("string")))
    return base.select(
        k.alias("kw_idx"), X.normalize_keyword(keyword).alias("keyword"), _pick(k % 6, SOURCES[:-1], SOURCES[-1]).alias("source"),
        F.when(k % 7 != 0, F.col("q")).alias("volume"), F.when(k % 5 != 0, (k * 37 % 101).cast("int")).alias("difficulty"), F.when(k % 11 != 0, (k * 13 % 100 + 1).cast("int")).alias("position"),
        X.serp_features(_pick(k % 9, RAW_FEATURES, "")).alias("serp_features"), F.lit(None).cast("string").alias("intent_label_raw"), F.when(k % 4 == 0, F.col("nm")).alias("parent_topic"),
        url.alias("competitor_url"), (k * 7 % 23).alias("clicks"), (k * 31 % 997).alias("impressions"),
    )


def keywords_sql(name: str = "kw", when: str = "true") -> str:
    case = lambda mod, values, other: f"case p_partkey % {mod} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + f" else '{other}' end"
    return f"""{name} as (select p_partkey as kw_idx, trim(concat({case(8, PREFIXES, "vs ")}, nm)) as keyword, {case(6, SOURCES[:-1], SOURCES[-1])} as source,
 case when p_partkey % 7 = 0 then null else q end as volume, case when p_partkey % 5 = 0 then null else cast((p_partkey * 37) % 101 as int) end as difficulty,
 case when p_partkey % 11 = 0 then null else cast((p_partkey * 13) % 100 + 1 as int) end as position,
 case when p_partkey % 9 > 4 then [] else string_split({case(9, FEATURES, "")}, ',') end as serp_features, case when p_partkey % 4 = 0 then nm else null end as parent_topic,
 case p_partkey % 3 when 0 then concat('https://www.{CLIENT}/p', p_partkey) when 1 then concat('https://rival.example/p', p_partkey) else null end as competitor_url,
 (p_partkey * 7) % 23 as clicks, (p_partkey * 31) % 997 as impressions
 from (select p_partkey, lower(p_name) as nm, coalesce(q, 0) as q from part left join (select l_partkey, cast(sum(l_quantity) as bigint) as q from lineitem where {when} group by 1) d on l_partkey = p_partkey) b)"""


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as its tokens, in lower case and joined by blanks."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(X.TOKEN), F.lit(1))
    return read(spark, sf_dir, "documents").select("doc_id", "lang", F.array_join(tokens, " ").alias("keyword"))


WHOLE_TEXTS_SQL = r"fl as (select doc_id, lang, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') as keyword from documents)"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly demand by priority: (grp, pos, v), positions dense from 0."""
    from pyspark.sql import Window

    monthly = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").cast("double").alias("v"))
    return monthly.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("m")) - 1).cast("long").alias("pos"), "v")


def event_series(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    """Sums of events' values by type and unit of time: (grp, pos, v), positions dense from 0."""
    from pyspark.sql import Window

    summed = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp"), F.date_trunc(unit, "ts").alias("m")).agg(F.round(F.sum("value"), 2).alias("v")).where("v is not null")
    return summed.select("grp", (F.row_number().over(Window.partitionBy("grp").orderBy("m")) - 1).cast("long").alias("pos"), "v")


SERIES_SQL = "sr as (select grp, row_number() over (partition by grp order by m) - 1 as pos, v from (select o_orderpriority as grp, date_trunc('month', o_orderdate) as m, cast(count(*) as double) as v from orders group by 1, 2) b)"
