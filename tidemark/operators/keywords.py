"""Row-level stages: enrichment, scopes, composite scores. Every stage adds columns and shuffles nothing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import numeric as N
from ..functions import text as X

YEAR = r"(?:^|[^\p{L}\p{N}_])20[0-9]{2}(?:$|[^\p{L}\p{N}_])"


@dataclass(frozen=True)
class Config:
    """Thresholds of the engine."""

    quickwin_volume_min: int = 100
    quickwin_volume_max: int = 5000
    quickwin_difficulty_max: int = 35
    striking_min: int = 4
    striking_max: int = 20
    overlap_min: float = 0.60
    aio_min: int = 60
    geo_min: int = 60
    long_tail_min: int = 5
    volume_reference: int = 100_000
    brands: tuple[str, ...] = ()
    client_domain: str = ""


def _when(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def _pick(pairs: list[tuple[str, Column]]) -> Column:
    """Name of the largest value; ties go to the first. Each value stands in the expression once.

    Filters on what is picked are pushed below the projection with the whole expression in place of the column, so an
    expression that repeats its inputs would grow with each stage.
    """
    return F.array_max(F.array(*(F.struct(v.cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(n).alias("n")) for k, (n, v) in enumerate(pairs))))["n"]


def language(df: DataFrame) -> DataFrame:
    """language, language_confidence: letters count two votes, stop words one each."""
    every = sorted({w for c in L.LANGUAGES for w in L.STOP_WORDS[c]})
    df = df.withColumn("_words", F.filter(X.words(F.col("keyword")), lambda t: t.isin(*every)))  # split once, and looked up once where no language has the word

    def votes(code):
        n = F.size(F.filter("_words", lambda t: t.isin(*L.STOP_WORDS[code])))  # a hash set, as whole texts are voted on too
        return n + F.when(F.col("keyword").rlike(f"[{L.LANGUAGE_CHARS[code]}]"), 2).otherwise(0) if code in L.LANGUAGE_CHARS else n

    df = df.withColumns({f"_v_{c}": votes(c) for c in L.LANGUAGES})
    best = F.greatest(*(F.col(f"_v_{c}") for c in L.LANGUAGES))
    return df.withColumns({
        "language": _pick([(c, F.col(f"_v_{c}")) for c in L.LANGUAGES]),  # without a vote, the first
        "language_confidence": F.when(best == 0, 0.4).otherwise(F.least(F.lit(1.0), 0.5 + best * 0.15)),
    }).drop("_words", *(f"_v_{c}" for c in L.LANGUAGES))


def intent_weights(keyword: Column, features: Column, raw: Column, markers: dict, pronouns: list[str]) -> dict[str, Column]:
    """Evidence for each intent from one language's markers."""
    token, padded = X.words(keyword), F.concat(F.lit(" "), keyword, F.lit(" "))
    first = F.substring_index(keyword, " ", 1)
    overlap = lambda *names: F.arrays_overlap(features, F.array(*(F.lit(n) for n in names)))
    info = _when(first.isin(*pronouns), 0.7) + _when(F.arrays_overlap(token, F.array(*(F.lit(m) for m in markers["informational"]))), 0.4) + _when(overlap("featured_snippet", "paa", "ai_overview"), 0.1)
    out = {
        "informational": info,
        "navigational": _when(X.has_any(keyword, markers["navigational"]), 0.9),
        "transactional": _when(X.has_any(keyword, markers["transactional"]), 0.8) + _when(overlap("shopping", "local_pack"), 0.1),
        "commercial_investigation": _when(X.has_any(padded, [f" {m} " for m in markers["commercial"]]), 0.7),
    }
    if raw is not None:
        lower = F.coalesce(F.lower(raw), F.lit(""))
        out = {k: v + _when(F.contains(lower, F.lit(k.replace("_", " "))) | F.contains(lower, F.lit(k)), 0.1) for k, v in out.items()}
    return out


def intent(df: DataFrame) -> DataFrame:
    """query_type, intent_confidence, funnel_stage, modality, temporal."""
    keyword = F.col("keyword")
    per = {code: intent_weights(keyword, F.col("serp_features"), F.col("intent_label_raw"), L.INTENT_MARKERS[code], L.QUESTION_PRONOUNS[code]) for code in L.LANGUAGES}
    df = df.withColumns({f"_w_{k}": X.by_language(F.col("language"), lambda code, k=k: per[code][k]) for k in L.INTENTS})
    query_type = _pick([(k, F.col(f"_w_{k}")) for k in L.INTENTS])  # without evidence, the first
    top = F.greatest(*(F.col(f"_w_{k}") for k in L.INTENTS))
    modality = F.when(X.has_any(keyword, L.CONVERSATION) | (F.size(X.words(keyword)) > 8), "conversational_ai").when(X.has_any(keyword, L.VOICE), "voice").otherwise("typed")
    temporal = F.when(X.has_any(keyword, L.SEASONS), "seasonal").when(keyword.rlike(YEAR), "event_driven").otherwise("evergreen")
    df = df.withColumns({"query_type": query_type, "intent_confidence": F.when(top == 0, 0.3).otherwise(F.least(F.lit(1.0), top)), "modality": modality, "temporal": temporal})
    stage = F.create_map(*(F.lit(x) for kv in L.FUNNEL.items() for x in kv))
    return df.withColumn("funnel_stage", F.element_at(stage, F.col("query_type"))).drop(*(f"_w_{k}" for k in L.INTENTS))


def shape(df: DataFrame, config: Config) -> DataFrame:
    """branded, brand_match, question_shape, question_confidence, token_count, char_count, tail_class."""
    keyword = F.col("keyword")
    brands = [b.strip().lower() for b in config.brands if b.strip()]
    match = F.coalesce(*(F.when(F.contains(keyword, F.lit(b)), b) for b in brands), F.lit("")) if brands else F.lit("")
    asked = X.by_language(F.col("language"), lambda code: _when(F.substring_index(keyword, " ", 1).isin(*L.QUESTION_PRONOUNS[code]), 0.6))
    sure = asked + _when(keyword.endswith("?"), 0.5) + _when(keyword.startswith("¿"), 0.5)
    n = F.size(X.words(keyword))
    return df.withColumns({
        "brand_match": match, "branded": match != "", "question_shape": sure > 0.4, "question_confidence": F.least(F.lit(1.0), sure),
        "token_count": n, "char_count": F.length(keyword), "tail_class": F.when(n <= 2, "head").when(n <= 4, "mid").otherwise("long_tail"),
    })


def enrich(df: DataFrame, config: Config = Config()) -> DataFrame:
    return shape(intent(language(df)), config)


def scopes(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Nine scopes for each keyword: label, confidence and score columns."""
    k, features, c = F.col("keyword"), F.col("serp_features"), config
    shown = F.array_contains(features, "ai_overview")
    points = (
        F.when(F.col("query_type") == "informational", 30).otherwise(0) + F.when(F.col("question_shape"), 25).otherwise(0) + F.when(F.col("token_count") >= 5, 10).otherwise(0)
        + F.when(X.has_any(k, L.HOW_TO), 20).otherwise(0)
    )
    df = df.withColumn("aio_score", F.when(shown, 100).otherwise(F.least(points, F.lit(90))))
    df = df.withColumn("aio_label", F.when(shown, "confirmed").when(F.col("aio_score") >= c.aio_min, "eligible").when(F.col("aio_score") >= 40, "possibly_eligible").otherwise("not_eligible"))
    points = (
        F.when(X.has_any(k, L.GEO_CONVERSATION), 25).otherwise(0) + F.when(F.col("token_count") >= 6, 20).otherwise(0)
        + F.when(F.col("query_type").isin("informational", "commercial_investigation"), 20).otherwise(0)
        + F.when(F.col("temporal").isin("evergreen", "event_driven"), 15).otherwise(0) + F.when(X.has_any(k, ("vs", "versus")), 20).otherwise(0)
    )
    df = df.withColumn("geo_score", F.least(points, F.lit(95)))
    geo, aio = F.col("geo_score") >= c.geo_min, F.col("aio_label").isin("confirmed", "eligible")
    v, d, p = F.col("volume"), F.col("difficulty"), F.col("position")
    wins = v.between(c.quickwin_volume_min, c.quickwin_volume_max) & (d <= c.quickwin_difficulty_max) & (p.isNull() | p.between(c.striking_min, 30)) & (F.col("query_type") != "navigational")
    foreign = F.lit(False) if not c.client_domain else F.coalesce((F.col("competitor_url") != "") & ~F.contains("competitor_url", F.lit(c.client_domain)), F.lit(False))
    strikes = F.coalesce(p.between(c.striking_min, c.striking_max) & (v >= 50), F.lit(False)) & ~foreign
    asks, paa = F.col("question_shape"), F.array_contains(features, "paa")
    n = F.col("token_count")
    long = n >= c.long_tail_min
    wins = F.coalesce(wins, F.lit(False))
    return df.withColumns({
        "aio_confidence": F.when(shown, 1.0).otherwise(F.least(F.lit(1.0), F.col("aio_score") / 100 + 0.1)),
        "geo_label": F.when(geo & aio, "dual").when(geo, "geo_only").when(aio, "aio_only").otherwise("neither"),
        "geo_confidence": F.least(F.lit(1.0), F.col("geo_score") / 100 + 0.1),
        "quick_win": F.when(wins, "quick_win").otherwise("not_quick_win"),
        "quick_win_confidence": F.when(v.isNull() | d.isNull(), 0.0).when(wins, F.least(F.lit(1.0), 0.6 + (c.quickwin_difficulty_max - d) / 100)).otherwise(0.5),
        "striking": F.when(~strikes, "not_striking").when(p <= 7, "top_page_climb").when(p <= 13, "second_page_break").otherwise("third_page_lift"),
        "striking_confidence": F.when(~strikes, 0.0).when(p <= 7, 0.85).when(p <= 13, 0.75).otherwise(0.65),
        "branded_label": F.when(F.col("branded"), "branded").otherwise("non_branded"),
        "question_paa": F.when(asks & paa, "question_and_paa").when(asks, "question").when(paa, "paa_only").otherwise("neither"),
        "question_paa_confidence": F.when(asks | paa, 0.9).otherwise(0.95),
        "long_tail": F.when(long & (F.col("modality") == "conversational_ai"), "long_tail_conversational").when(long, "long_tail_classical").when(n >= 3, "mid").otherwise("head"),
        "long_tail_confidence": F.when(long & (F.col("modality") == "conversational_ai"), 0.9).when(long, 0.85).when(n >= 3, 0.8).otherwise(0.85),
        "seasonality": F.when(X.has_any(k, L.SEASONAL), "seasonal").when(k.rlike(YEAR), "event_driven").otherwise("evergreen"),
        "seasonality_confidence": F.when(X.has_any(k, L.SEASONAL), 0.9).when(k.rlike(YEAR), 0.85).otherwise(0.7),
    })


def scores(df: DataFrame, config: Config = Config()) -> DataFrame:
    """Four composite scores; clustered (boolean) tells whether the keyword is in a cluster, cannibalisation (if there, see cannibal) the risk that pages compete."""
    volume = F.coalesce(N.volume_score(F.col("volume"), config.volume_reference), F.lit(0.0))
    ease = F.coalesce((100 - F.col("difficulty")).cast("double"), F.lit(50.0))
    place = N.position_score(F.col("position"))
    rich = F.size("serp_features") > 0
    serp = F.when(rich, 60.0).otherwise(50.0)
    main = (
        0.35 * volume + 0.25 * ease + 0.15 * N.intent_score(F.col("query_type"), "main") + 0.10 * F.coalesce(place, F.lit(30.0))
        + 0.10 * F.when(F.col("clustered"), 70.0).otherwise(60.0) + 0.05 * serp
    )
    complete = F.when(F.col("volume").isNotNull(), 0.35).otherwise(0.0) + F.when(F.col("difficulty").isNotNull(), 0.25).otherwise(0.0) + F.lit(0.15)
    complete = complete + F.when(F.col("position").isNotNull(), 0.10).otherwise(0.05) + F.lit(0.10) + F.when(rich, 0.05).otherwise(0.025)
    trust = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in L.SOURCE_RELIABILITY.items() for x in kv)), F.col("source")), F.lit(0.7))
    sure = F.pow(complete * trust * F.sqrt(F.col("language_confidence") * F.col("intent_confidence")), F.lit(1 / 3))
    near = F.when(F.col("position").isNull(), 80.0).otherwise(F.coalesce(place, F.lit(30.0)))
    quick = 0.30 * ease + 0.25 * volume + 0.15 * near + 0.15 * N.intent_score(F.col("query_type"), "quick_win") + F.lit(0.10 * 60) + 0.05 * serp
    strategic = F.lit(0.30 * 70) + 0.20 * volume + 0.15 * N.intent_score(F.col("query_type"), "main") + F.lit(0.15 * 50) + 0.10 * F.col("geo_score") + 0.10 * ease
    defence = 0.30 * F.when(F.col("branded"), 100.0).otherwise(30.0) + 0.20 * F.col("geo_score") + 0.15 * F.col("aio_score") + 0.10 * volume
    if "cannibalisation" in df.columns:
        defence = defence + 0.25 * F.coalesce("cannibalisation", F.lit(0.0))
    wins = F.col("quick_win") == "quick_win"
    return df.withColumns({
        "score_main": N.tenths(main), "confidence_main": F.round(sure, 3),
        "score_quick_win": F.when(wins, N.tenths(quick)).otherwise(0.0), "confidence_quick_win": F.when(wins, 0.85).otherwise(0.0),
        "score_strategic": N.tenths(strategic), "confidence_strategic": F.lit(0.80), "score_aeo": N.tenths(defence), "confidence_aeo": F.lit(0.80),
    }).withColumn("action", action())


def action() -> Column:
    """What to do with a keyword."""
    return (
        F.when(F.col("quick_win") == "quick_win", "create").when(F.col("striking").isin("top_page_climb", "second_page_break"), "update").when(F.col("striking") == "third_page_lift", "restructure")
        .when(F.col("score_main") < 30, "ignore").otherwise("monitor")
    )


def routing() -> Column:
    """Which AI surfaces a keyword belongs to."""
    return F.col("geo_label")
