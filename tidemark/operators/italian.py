"""Language correction: Italian votes, corpus prior, intent override."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from .clusters import settle
from .keywords import _pick, intent_weights

PRIOR_SHARE, PRIOR_EVIDENCE, PRIOR_CONFIDENCE = 0.5, 10, 0.55


@dataclass(frozen=True)
class Gazetteer:
    """Words that vote for Italian, question pronouns, and intent markers by axis."""

    cues: tuple[str, ...] = tuple(L.IT_CUES)
    pronouns: tuple[str, ...] = tuple(L.IT_PRONOUNS)
    markers: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {k: tuple(v) for k, v in L.IT_MARKERS.items()})


def load_gazetteer(path: str | None = None) -> Gazetteer:
    """The built-in gazetteer, or one from a JSON file (language_cues, question_pronouns, intent_markers by four axes); every call gives its own."""
    if path is None:
        return Gazetteer()
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError as e:
        raise ValueError(f"no gazetteer: {path}") from e
    except json.JSONDecodeError as e:
        raise ValueError(f"not JSON: {path}") from e
    fields, axes = ("language_cues", "question_pronouns", "intent_markers"), ("transactional", "commercial", "informational", "navigational")
    if missing := [f for f in fields if f not in data] or [f"intent_markers.{a}" for a in axes if a not in data["intent_markers"]]:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return Gazetteer(tuple(data["language_cues"]), tuple(data["question_pronouns"]), {a: tuple(data["intent_markers"][a]) for a in axes})


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def votes(df: DataFrame, words: Gazetteer = Gazetteer()) -> DataFrame:
    """it_score and engine_score of each keyword (keyword, language, language_confidence)."""
    cues = sorted({*words.cues, *words.pronouns})
    it = F.size(F.filter(X.words(F.col("keyword")), lambda t: t.isin(*cues))) + F.when(F.col("keyword").rlike(f"[{L.IT_DIACRITICS}]"), 2).otherwise(0)
    engine = F.when(F.col("language_confidence") < 0.5, 0).otherwise(F.bround((F.col("language_confidence") - 0.5) / 0.15, 0).cast("int"))
    return df.withColumns({"it_score": it, "engine_score": engine})


def morphology(keyword: Column) -> Column:
    """Whether a token without foreign letters carries an Italian suffix."""
    native = F.filter(X.words(keyword), lambda t: ~t.rlike(f"[{L.IT_FOREIGN_LETTERS}]"))
    return F.exists(native, lambda t: t.rlike(".{2}(" + "|".join(L.IT_SUFFIXES) + ")$"))


def shape(keyword: Column) -> Column:
    """Whether every token but numbers ends in a vowel and has no foreign letter or sequence."""
    named = F.filter(X.words(keyword), lambda t: ~t.rlike("^[0-9]+$"))
    return (F.size(named) > 0) & F.forall(named, lambda t: ~t.rlike(f"[{L.IT_FOREIGN_LETTERS}]|{'|'.join(L.IT_FOREIGN)}") & t.rlike(f"[{L.IT_VOWELS}]$"))


def evidence(voted: DataFrame) -> DataFrame:
    """One row: italian, engine, bearing, share, prior."""
    own, theirs = F.col("it_score") >= 1, F.col("language_confidence") >= 0.65
    got = voted.agg(F.count_if(own).alias("italian"), F.count_if(theirs).alias("engine"), F.count_if(own | theirs).alias("bearing"))
    share = F.when(F.col("bearing") > 0, F.round(F.col("italian") / F.col("bearing"), 4)).otherwise(0.0)
    return got.withColumn("share", share).withColumn("prior", (F.col("bearing") >= PRIOR_EVIDENCE) & (F.col("share") >= PRIOR_SHARE))


def correct(df: DataFrame, words: Gazetteer = Gazetteer()) -> DataFrame:
    """df with language, language_confidence and query_type corrected, and reason (null where nothing changed)."""
    voted = settle(votes(df, words))  # read twice: for the evidence of all rows, and row by row
    both = voted.crossJoin(F.broadcast(evidence(voted).select("prior")))  # one row of one flag
    k = F.col("keyword")
    zero = (F.col("it_score") == 0) & (F.col("engine_score") == 0)
    reason = (
        F.when(F.col("language_confidence") >= 1, None).when((F.col("it_score") > 0) & (F.col("it_score") > F.col("engine_score")), "vote")
        .when(F.col("prior") & (F.col("it_score") >= 1) & (F.col("it_score") == F.col("engine_score")), "tie_break")
        .when(F.col("prior") & zero & morphology(k), "morphology").when(F.col("prior") & zero & shape(k), "shape")
    )
    out = both.withColumn("reason", reason)
    w = intent_weights(k, F.col("serp_features"), None, words.markers, words.pronouns)
    padded = F.concat(F.lit(" "), k, F.lit(" "))
    fired = (
        F.substring_index(k, " ", 1).isin(*words.pronouns) | X.has_any(k, words.markers["transactional"]) | X.has_any(padded, [f" {m} " for m in words.markers["commercial"]])
        | X.has_any(k, words.markers["navigational"]) | F.arrays_overlap(X.words(k), _array(words.markers["informational"]))
    )
    changed = F.col("reason").isNotNull()
    sure = F.when(F.col("reason") == "vote", F.least(F.lit(1.0), 0.5 + 0.15 * F.col("it_score"))).otherwise(PRIOR_CONFIDENCE)
    return out.withColumns({
        "engine_query_type": F.col("query_type"), "query_type": F.when(changed & fired, _pick([(n, w[n]) for n in L.INTENTS])).otherwise(F.col("query_type")),
        "language": F.when(changed, "it").otherwise(F.col("language")), "language_confidence": F.when(changed, F.round(sure, 4)).otherwise(F.col("language_confidence")),
    }).drop("prior")
