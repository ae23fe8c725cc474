"""The whole engine over export files: from inputs to a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import clusters as C
from ..operators import compare as R
from ..operators import entities as E
from ..operators import fanout as O
from ..operators import italian as I
from ..operators import keywords as K
from ..operators import pulse as P
from ..operators import summary as S
from ..sources import exports, sinks


@dataclass
class Run:
    """Results by slot; a slot that wasn't asked for, or has no input, is missing."""

    keywords: DataFrame
    clusters: DataFrame
    membership: DataFrame
    slots: dict[str, DataFrame] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        return S.shares(self.keywords)

    def gaps(self, client: str) -> DataFrame:
        return S.gaps(self.keywords, client)


def analyze(keywords: DataFrame, config: K.Config = K.Config()) -> Run:
    """Enrich, cluster, scope and score a canonical corpus (kw_idx, keyword, source, volume, ...)."""
    enriched = C.settle(K.enrich(keywords, config))
    clusters, membership = C.leader_clusters(enriched, config.overlap_min)
    membership = C.settle(membership)
    marked = enriched.join(membership.select("kw_idx", F.lit(True).alias("clustered")), "kw_idx", "left").withColumn("clustered", F.coalesce("clustered", F.lit(False)))
    scored = C.settle(K.scores(K.scopes(marked, config), config))
    return Run(scored, C.settle(C.describe(clusters, membership, scored)), membership)


def _fan(slots: dict) -> DataFrame | None:
    """(cluster_index, gatekeepers, missing) of the fan-out slots, where they are."""
    if "coverage" not in slots:
        return None
    keepers = slots["gatekeepers"].groupBy("cluster_index").agg(F.array_sort(F.collect_set("query")).alias("gatekeepers"))
    missing = F.filter(F.split("missing", ","), lambda a: a != "")
    return slots["coverage"].select("cluster_index", missing.alias("missing")).join(keepers, "cluster_index", "left")


def run_modules(run: Run, modules=("entity_web", "fan_out_radar", "demand_pulse", "citation_grid", "click_ceiling"), series: DataFrame | None = None, year: int = 2026) -> Run:
    """Add slots in the given order; each reads the slots that are there."""
    kw, slots = run.keywords, run.slots
    if unknown := set(modules) - set(sinks.SLOTS):
        raise ValueError(f"unknown modules: {sorted(unknown)}")
    for m in modules:
        if m == "language_layer":
            run.keywords = kw = C.settle(I.correct(kw))
        elif m == "entity_web":
            own = C.settle(E.with_terms(kw.select("kw_idx", "keyword", "language", "volume", "position")))
            slots["entities"] = C.settle(E.salient(own))
            slots["graph"] = C.settle(E.graph(own, slots["entities"]))
            slots["spread"] = C.settle(E.spread(own, slots["entities"], run.membership))
            slots["entity_gaps"] = C.settle(E.gap_heads(E.gaps(slots["entities"]), slots["spread"], run.clusters))
            slots["authority"] = C.settle(E.authority(own, slots["entities"], run.membership))
        elif m == "fan_out_radar":
            docs = C.settle(run.membership.join(kw.select("kw_idx", "keyword"), "kw_idx"))
            near = None
            if "graph" in slots:
                rank = slots["entities"].select("term", "rank")
                ends = slots["graph"].select(F.col("a").alias("head"), F.col("b").alias("term")).unionByName(slots["graph"].select(F.col("b").alias("head"), F.col("a").alias("term")))
                near = ends.join(rank, "term").select("head", "term", F.col("rank").cast("int"))
            made = C.settle(O.sub_queries(run.clusters, docs, near, year))
            queries = made.select("cluster_index", F.col("norm").alias("query"), "norm", "archetype")
            slots["sub_queries"], slots["coverage"] = (C.settle(x) for x in O.coverage(queries, C.settle(O.bm25(queries, docs))))  # each is read by later slots
            slots["gatekeepers"] = C.settle(O.gatekeepers(slots["sub_queries"], kw.select(X.norm_key(F.col("keyword")).alias("norm"), "volume")))
            slots["fan_out"] = O.run_summary(slots["coverage"], slots["gatekeepers"])
        elif m == "demand_pulse" and series is not None:
            keyed = kw.select("kw_idx", X.norm_key(F.col("keyword")).alias("norm_kw")).join(series, "norm_kw").select("kw_idx", "period", "value")
            whole = C.settle(P.cluster_series(keyed, run.membership))
            slots["state"] = C.settle(P.states(whole, P.seasonal_strength(whole)).withColumnRenamed("grp", "cluster_index"))
            slots["markers"] = P.markers(kw, run.membership)
        elif m == "citation_grid":
            slots["readiness"] = C.settle(A.readiness(A.cluster_signals(kw, run.membership), slots.get("authority"), slots.get("coverage"), slots.get("state")))
            if "spread" in slots:
                slots["checklist"] = A.checklist(kw, run.membership, slots["spread"], slots["entity_gaps"], _fan(slots), slots.get("state"))
        elif m == "click_ceiling":
            bands = C.settle(A.keyword_bands(kw.join(run.membership, "kw_idx"), slots.get("readiness")))
            slots["keyword_bands"] = bands
            slots["bands"] = A.cluster_bands(bands, slots.get("state"), slots.get("authority"), slots.get("coverage"))
            slots["opportunities"], slots["provenance"] = A.top_opportunities(bands), A.provenance_mix(bands)
    return run


def from_exports(spark: SparkSession, inputs, config: K.Config = K.Config(), modules=(), year: int | None = None, series_path: str | None = None) -> Run:
    """Read exports (and the series in them or beside them), analyse, run modules."""
    paths = exports.expand(inputs)
    series = exports.read_series(spark, series_path) if series_path else exports.read_month_columns(spark, paths, year)
    return run_modules(analyze(exports.read_exports(spark, paths), config), modules, series, year or 2026)


def compare(base: Run, current: Run, key: str = "keyword", client: str = "") -> dict[str, DataFrame]:
    """Movements between two runs."""
    fields = ["quick_win", "position", "volume", "score_main", "score_aeo"]
    pairs = R.paired(R.representatives(base.keywords, key), R.representatives(current.keywords, key), fields, key)
    return {
        "quick_wins": pairs.select(key, R.resolution().alias("movement")).where("movement is not null"), "deltas": R.score_deltas(pairs, ["score_main", "score_aeo"]),
        "added": pairs.where("in_current and not in_base").select(key), "dropped": pairs.where("in_base and not in_current").select(key), "intents": R.intent_shift(base.keywords, current.keywords),
        "gaps": R.gap_changes(base.gaps(client), current.gaps(client)), "risers": R.movers(pairs, "score_main", True), "fallers": R.movers(pairs, "score_main", False),
    }
