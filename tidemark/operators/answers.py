"""Citation readiness, click bands, observed results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import numeric as N
from .clusters import settle

ANSWER_LABELS = ("question", "question_and_paa", "paa_only")


def _has(*names) -> Column:
    return F.arrays_overlap("serp_features", F.array(*(F.lit(n) for n in names)))


def cluster_signals(df: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster_index, eligibility, extractability, structured_demand (0 to 1), demand."""
    value = F.least(F.lit(1.0), F.col("aio_score") / 100 + F.when(F.col("geo_label").isin("dual", "geo_only"), 0.1).otherwise(0.0))
    answer = F.col("question_paa").isin(*ANSWER_LABELS) | F.col("question_shape") | _has("featured_snippet", "paa", "ai_overview")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    rows = df.join(membership, "kw_idx")
    return rows.groupBy("cluster_index").agg(
        F.round(F.avg(value), 6).alias("eligibility"), share(answer).alias("extractability"), share(_has("featured_snippet", "paa", "shopping")).alias("structured_demand"), F.sum(F.coalesce("volume", F.lit(0))).alias("demand"),
    )


def blend(values: dict[str, Column], weights: dict[str, float] = L.READINESS_WEIGHTS) -> Column:
    """Weighted mean of the values that are there, 0 to 100; each weight is renormalised and rounded before use."""
    total = sum((F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in values.items()), F.lit(0.0))
    return F.round(100 * sum((F.when(v.isNotNull(), v * F.round(F.lit(weights[k]) / total, 6)).otherwise(0.0) for k, v in values.items()), F.lit(0.0)), 4)


def freshness(state: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in L.FRESHNESS.items() for x in kv)), state)


def readiness(signals: DataFrame, authority: DataFrame | None = None, coverage: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """cluster_index, readiness, expected_share. Slots that are missing leave their inputs out."""
    df = signals
    for slot, column in ((authority, "authority"), (coverage, "coverage"), (state, "state")):
        df = df.join(slot.select("cluster_index", column), "cluster_index", "left") if slot is not None else df.withColumn(column, F.lit(None).cast("string" if column == "state" else "double"))
    score = blend({
        "eligibility": F.col("eligibility"), "query_family": F.col("coverage"), "entity_coverage": F.col("authority"), "extractability": F.col("extractability"),
        "structured_demand": F.col("structured_demand"), "freshness": freshness(F.col("state")),
    })
    df = settle(df.select("cluster_index", score.alias("readiness"), "demand").withColumn("w", F.col("readiness") * F.col("demand")))  # one row a cluster, read twice below
    total = df.agg(F.sum("w").alias("total"))
    shared = df.crossJoin(F.broadcast(total))  # one row of one number
    return shared.select("cluster_index", "readiness", F.when(F.col("total") > 0, F.round(100 * F.col("w") / F.col("total"), 4)).otherwise(0.0).alias("expected_share"))


def keyword_bands(df: DataFrame, readiness_: DataFrame | None = None) -> DataFrame:
    """Winnable clicks of each keyword with volume: current, low, high, provenance. df: kw_idx, cluster_index, volume, position, serp_features."""
    df = df.where("volume > 0")
    df = df.join(readiness_.select("cluster_index", "readiness"), "cluster_index", "left") if readiness_ is not None else df.withColumn("readiness", F.lit(0.0))
    ranked = F.col("position") >= 1
    v, f, none = F.col("volume").cast("double"), F.col("serp_features"), F.lit(0.0)
    target = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(F.when(ranked, F.col("position")), F.lit(3))))
    df = df.withColumns({
        "current": F.when(ranked, v * N.effective_ctr(F.col("position"), f, none)).otherwise(0.0),
        "provenance": N.ctr_provenance(F.when(ranked, F.col("position"))),
        "_h": v * N.effective_ctr(F.lit(1), f, F.least(F.lit(1.0), F.coalesce("readiness", none) / 100)), "_l": v * N.effective_ctr(target, f, none),
    })
    high, low = F.greatest(none, F.col("_h") - F.col("current")), F.greatest(none, F.col("_l") - F.col("current"))
    unsure = F.element_at(F.create_map(*(F.lit(x) for kv in L.UNCERTAINTY.items() for x in kv)), F.col("provenance"))
    return df.select("kw_idx", "cluster_index", "volume", "position", "provenance", F.array_contains(f, "ai_overview").alias("ai"), "current", (F.least(low, high) * (1 - unsure)).alias("low"), (F.greatest(low, high) * (1 + unsure)).alias("high"))


def cluster_bands(bands: DataFrame, state: DataFrame | None = None, authority: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """cluster_index, current, low, high, ceilings: sums adjusted by demand state, authority and coverage."""
    df = bands.groupBy("cluster_index").agg(F.sum("current").alias("current"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.avg(F.when(F.col("ai"), 1.0).otherwise(0.0)).alias("ai_share"))
    for slot, column in ((state, "state"), (authority, "authority"), (coverage, "coverage")):
        df = df.join(slot.select("cluster_index", column), "cluster_index", "left") if slot is not None else df.withColumn(column, F.lit(None).cast("string" if column == "state" else "double"))
    factor = lambda k: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for s, v in L.DEMAND_FACTORS.items() for x in (s, v[k]))), F.col("state")), F.lit(1.0))
    thin = (F.col("ai_share") > 0.5) & (F.col("coverage") < 0.5)
    high = F.col("high") * factor(1) * F.coalesce(0.7 + 0.3 * F.col("authority"), F.lit(1.0)) * F.when(thin, 0.7 + 0.3 * F.col("coverage")).otherwise(1.0)
    df = df.withColumns({"_l": F.col("low") * factor(0), "_h": high})
    low, high = F.least("_l", "_h"), F.greatest("_l", "_h")
    whole = lambda c: F.bround(c, 0).cast("long")
    return df.select("cluster_index", whole(F.col("current")).alias("current_clicks"), whole(low).alias("winnable_low"), whole(high).alias("winnable_high"), whole(F.col("current") + low).alias("ceiling_low"), whole(F.col("current") + high).alias("ceiling_high"), F.round("ai_share", 4).alias("ai_share"))


def first_keyword(df: DataFrame) -> DataFrame:
    """norm, kw_idx: the first keyword of each normal form. df: kw_idx, norm."""
    return df.groupBy("norm").agg(F.min("kw_idx").alias("kw_idx"))


def observed_clicks(observed: DataFrame, keywords: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster_index, clicks, matched, mean_position (weighted by impressions). observed: norm, clicks, impressions, position."""
    hit = observed.join(first_keyword(keywords), "norm").join(membership, "kw_idx")
    seen = F.when((F.col("impressions") > 0) & F.col("position").isNotNull(), F.col("impressions"))
    return hit.groupBy("cluster_index").agg(F.sum("clicks").alias("clicks"), F.count("*").alias("matched"), F.round(F.try_divide(F.sum(F.col("position") * seen), F.sum(seen)), 2).alias("mean_position"))


def unmatched(observed: DataFrame, keywords: DataFrame) -> DataFrame:
    return observed.join(first_keyword(keywords), "norm", "left_anti").select("norm").distinct()


def citation_shares(cited: DataFrame) -> DataFrame:
    """domain, weight, share: each query's weight is split equally over its citations. cited: query, weight, domain."""
    per = cited.groupBy("query").agg(F.count("*").alias("n"))
    got = cited.join(per, "query").groupBy("domain").agg(F.sum(F.col("weight") / F.col("n")).alias("weight"))
    total = got.agg(F.sum("weight").alias("t"))
    return got.crossJoin(F.broadcast(total)).select("domain", F.round("weight", 6).alias("weight"), F.round(100 * F.col("weight") / F.col("t"), 4).alias("share"))  # one row of one number


def competitor_split(shares: DataFrame, top: int = 8) -> DataFrame:
    """(domain, share): the largest domains, the others folded into `other`."""
    first = shares.orderBy(F.col("share").desc(), "domain").select("domain").limit(top).withColumn("kept", F.lit(True))
    named = shares.join(F.broadcast(first), "domain", "left").select(F.when(F.col("kept"), F.col("domain")).otherwise("other").alias("domain"), "share")
    return named.groupBy("domain").agg(F.round(F.sum("share"), 4).alias("share"))


def top_opportunities(bands: DataFrame, top: int = 6) -> DataFrame:
    """(cluster_index, rank, kw_idx, low, high): each cluster's keywords of most winnable clicks, in whole clicks; equals in the corpus's order."""
    order = Window.partitionBy("cluster_index").orderBy(F.round("high", 6).desc(), "kw_idx")
    ranked = bands.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("cluster_index", "rank", "kw_idx", F.bround("low", 0).cast("long").alias("low"), F.bround("high", 0).cast("long").alias("high"))


def provenance_mix(bands: DataFrame) -> DataFrame:
    """(cluster_index, provenance, n): how the members' ranks are known."""
    return bands.groupBy("cluster_index", "provenance").agg(F.count("*").alias("n"))


def reanchored(bands: DataFrame, observed: DataFrame) -> DataFrame:
    """Observed clusters with the winnable band that measured clicks leave: the ceilings less the clicks, 0 at least."""
    both = observed.join(bands.select("cluster_index", "current_clicks", "winnable_low", "winnable_high", "ceiling_low", "ceiling_high"), "cluster_index", "left")
    rest = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.col(c) - F.col("clicks")))
    low, high = rest("ceiling_low"), rest("ceiling_high")
    whole = lambda c: F.bround(c, 0).cast("long")
    return both.select("cluster_index", "matched", whole(F.col("clicks").cast("double")).alias("observed_clicks"), "mean_position", "current_clicks", "winnable_low", "winnable_high", whole(F.least(low, high)).alias("observed_low"), whole(F.greatest(low, high)).alias("observed_high"))


def checklist(df: DataFrame, membership: DataFrame, spread: DataFrame, gaps: DataFrame, fan: DataFrame | None = None, state: DataFrame | None = None, top: int = 8) -> DataFrame:
    """(cluster_index, component, requires, basis, action, examples): six structural signals for each cluster with members.

    spread: (term, dominant_cluster); gaps: (term, demand_volume, suggested_cluster); fan: (cluster_index, gatekeepers, missing),
    arrays; state: (cluster_index, state). Examples are at most `top`, joined by a bar.
    """
    rows = df.join(membership, "kw_idx")
    answer = F.col("question_paa").isin(*ANSWER_LABELS) | F.col("question_shape") | _has("featured_snippet", "paa", "ai_overview")
    questions = rows.groupBy("cluster_index").agg(F.array_sort(F.collect_set(F.when(answer, F.col("keyword")))).alias("questions"))
    counted = rows.select("cluster_index", F.explode("serp_features").alias("f")).where(F.col("f").isin("featured_snippet", "paa", "shopping")).groupBy("cluster_index", "f").agg(F.count("*").alias("n"))
    rewarded = counted.groupBy("cluster_index").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "f"))), lambda x: x["f"]).alias("rewarded"))
    own = spread.groupBy(F.col("dominant_cluster").alias("cluster_index")).agg(F.array_sort(F.collect_set("term")).alias("own"))
    open_ = gaps.groupBy(F.col("suggested_cluster").alias("cluster_index")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("demand_volume")).alias("v"), "term"))), lambda x: x["term"]).alias("open"))
    out = questions
    for slot in (rewarded, own, open_):
        out = out.join(slot, "cluster_index", "left")
    out = out.join(fan.select("cluster_index", "gatekeepers", "missing"), "cluster_index", "left") if fan is not None else out.withColumns({"gatekeepers": F.lit(None).cast("array<string>"), "missing": F.lit(None).cast("array<string>")})
    out = out.join(state.select("cluster_index", "state"), "cluster_index", "left") if state is not None else out.withColumn("state", F.lit(None).cast("string"))
    none = F.array().cast("array<string>")
    some = lambda c: F.size(F.coalesce(c, none)) > 0
    either = lambda a, b: F.when(some(F.col(a)), F.col(a)).otherwise(F.array_sort(F.coalesce(F.col(b), none)))
    moving = F.col("state").isNotNull() & (F.col("state") != "unknown")
    examples = {
        "extractability": F.col("questions"), "entity_coverage": either("open", "own"), "structured_signals": F.col("rewarded"),
        "information_gain": F.when(some(F.col("gatekeepers")), F.array_sort("gatekeepers")).otherwise(F.array_sort(F.coalesce("missing", none))), "freshness_proxy": none, "source_cues": none,
    }
    basis = {
        "extractability": F.when(some(F.col("questions")), L.CHECKLIST_BASIS["questions"]).otherwise(L.CHECKLIST_BASIS["no_questions"]), "entity_coverage": F.lit(L.CHECKLIST_BASIS["entities"]),
        "structured_signals": F.when(some(F.col("rewarded")), L.CHECKLIST_BASIS["features"]).otherwise(L.CHECKLIST_BASIS["no_features"]), "information_gain": F.lit(L.CHECKLIST_BASIS["fan_out"]),
        "freshness_proxy": F.when(moving, F.concat(F.lit(L.CHECKLIST_BASIS["state"]), "state")).otherwise(L.CHECKLIST_BASIS["no_state"]), "source_cues": F.lit(L.CHECKLIST_BASIS["sources"]),
    }
    items = [
        F.struct(F.lit(name).alias("component"), F.lit(requires).alias("requires"), basis[name].alias("basis"), F.lit(action).alias("action"), F.array_join(F.slice(F.coalesce(examples[name], none), 1, top), "|").alias("examples"))
        for name, (requires, action) in L.CHECKLIST.items()
    ]
    return out.select("cluster_index", F.explode(F.array(*items)).alias("i")).select("cluster_index", "i.*")
