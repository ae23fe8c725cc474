"""The engine's stages as DuckDB SQL, written from the rules and not from the Spark code: the oracle's chain of CTEs."""

from __future__ import annotations

from ..functions import lexicon as L
from ..functions import numeric as N
from .bindings import CLIENT, WHOLE_TEXTS_SQL, SERIES_SQL, keywords_sql

q = lambda s: "'" + s.replace("'", "''") + "'"
any_of = lambda col, parts: "(" + " or ".join(f"contains({col}, {q(p)})" for p in parts) + ")"
array = lambda parts: "[" + ", ".join(map(q, parts)) + "]"
case = lambda key, table, other: f"case {key} " + " ".join(f"when {q(k)} then {v}" for k, v in table.items()) + f" else {other} end"
by_lang = lambda build: "case language " + " ".join(f"when {q(c)} then {build(c)}" for c in L.LANGUAGES) + " end"
one = lambda test, v: f"case when {test} then {v} else 0 end"
WORDS = "list_filter(string_split_regex(keyword, '\\s+'), lambda t: t <> '')"
YEAR = r"regexp_matches(keyword, '(^|[^\p{L}\p{N}_])20[0-9]{2}($|[^\p{L}\p{N}_])')"


def language_sql(name: str, source: str) -> str:
    votes = {c: f"len(list_filter(ws, lambda t: list_contains({array(L.STOP_WORDS[c])}, t)))" + (f" + case when regexp_matches(keyword, '[{L.LANGUAGE_CHARS[c]}]') then 2 else 0 end" if c in L.LANGUAGE_CHARS else "") for c in L.LANGUAGES}
    return f"""{name}_w as (select *, {WORDS} as ws from {source}), {name}_v as (select *, {", ".join(f"{v} as v_{c}" for c, v in votes.items())} from {name}_w),
{name} as (select *, case when v_en = best then 'en' when v_fr = best then 'fr' when v_de = best then 'de' else 'es' end as language, case when best = 0 then 0.4 else least(1.0, 0.5 + best * 0.15) end as language_confidence
 from (select *, greatest(v_en, v_fr, v_de, v_es) as best from {name}_v) b)"""


def intent_sql(name: str, source: str) -> str:
    first = "string_split(keyword, ' ')[1]"
    weight = {
        "informational": lambda c: f"{one(f'list_contains({array(L.QUESTION_PRONOUNS[c])}, {first})', 0.7)} + {one(f'list_has_any(ws, {array(L.INTENT_MARKERS[c]['informational'])})', 0.4)}",
        "navigational": lambda c: one(any_of("keyword", L.INTENT_MARKERS[c]["navigational"]), 0.9),
        "transactional": lambda c: one(any_of("keyword", L.INTENT_MARKERS[c]["transactional"]), 0.8),
        "commercial_investigation": lambda c: one(any_of("concat(' ', keyword, ' ')", [f" {m} " for m in L.INTENT_MARKERS[c]["commercial"]]), 0.7),
    }
    has = lambda *f: f"list_has_any(serp_features, {array(f)})"
    extra = {"informational": f" + {one(has('featured_snippet', 'paa', 'ai_overview'), 0.1)}", "transactional": f" + {one(has('shopping', 'local_pack'), 0.1)}"}
    w = ", ".join(f"cast({by_lang(weight[k])}{extra.get(k, '')} as double) as w_{k}" for k in L.INTENTS)
    total = " + ".join(f"w_{k}" for k in L.INTENTS)
    return f"""{name}_a as (select *, {w} from {source}), {name}_b as (select * replace (case when {total} = 0 then 0.3 else w_informational end as w_informational) from {name}_a),
{name} as (select *, case when w_informational = top then 'informational' when w_navigational = top then 'navigational' when w_transactional = top then 'transactional' else 'commercial_investigation' end as query_type, least(1.0, top) as intent_confidence,
 case when {any_of("keyword", L.CONVERSATION)} or len(ws) > 8 then 'conversational_ai' when {any_of("keyword", L.VOICE)} then 'voice' else 'typed' end as modality,
 case when {any_of("keyword", L.SEASONS)} then 'seasonal' when {YEAR} then 'event_driven' else 'evergreen' end as temporal, len(ws) as token_count,
 {one(f"list_contains({by_lang(lambda c: array(L.QUESTION_PRONOUNS[c]))}, {first})", 0.6)} + {one("ends_with(keyword, '?')", 0.5)} + {one("starts_with(keyword, '¿')", 0.5)} as asks
 from (select *, greatest({", ".join(f"w_{k}" for k in L.INTENTS)}) as top from {name}_b) b)"""


SCOPES = f"""sc_a as (select *, asks > 0.4 as question_shape, list_contains(serp_features, 'ai_overview') as shown, list_contains(serp_features, 'paa') as paa from en),
sc_b as (select *, case when shown then 100 else least(90, {one("query_type = 'informational'", 30)} + {one("question_shape", 25)} + {one("token_count >= 5", 10)} + {one(any_of("keyword", L.HOW_TO), 20)}) end as aio_score,
 least(95, {one(any_of("keyword", L.GEO_CONVERSATION), 25)} + {one("token_count >= 6", 20)} + {one("query_type in ('informational', 'commercial_investigation')", 20)} + {one("temporal in ('evergreen', 'event_driven')", 15)} + {one(any_of("keyword", ("vs", "versus")), 20)}) as geo_score from sc_a),
sc_c as (select *, case when shown then 'confirmed' when aio_score >= 60 then 'eligible' when aio_score >= 40 then 'possibly_eligible' else 'not_eligible' end as aio_label,
 coalesce(volume between 100 and 5000 and difficulty <= 35 and (position is null or position between 4 and 30) and query_type <> 'navigational', false) as wins,
 coalesce(position between 4 and 20 and volume >= 50, false) and not coalesce(competitor_url <> '' and not contains(competitor_url, '{CLIENT}'), false) as strikes from sc_b),
sc as (select *, case when geo_score >= 60 and aio_label in ('confirmed', 'eligible') then 'dual' when geo_score >= 60 then 'geo_only' when aio_label in ('confirmed', 'eligible') then 'aio_only' else 'neither' end as geo_label,
 case when wins then 'quick_win' else 'not_quick_win' end as quick_win, case when volume is null or difficulty is null then 0.0 when wins then least(1.0, 0.6 + (35 - difficulty) / 100.0) else 0.5 end as quick_win_confidence,
 case when not strikes then 'not_striking' when position <= 7 then 'top_page_climb' when position <= 13 then 'second_page_break' else 'third_page_lift' end as striking,
 case when question_shape and paa then 'question_and_paa' when question_shape then 'question' when paa then 'paa_only' else 'neither' end as question_paa,
 case when token_count >= 5 and modality = 'conversational_ai' then 'long_tail_conversational' when token_count >= 5 then 'long_tail_classical' when token_count >= 3 then 'mid' else 'head' end as long_tail,
 case when {any_of("keyword", L.SEASONAL)} then 'seasonal' when {YEAR} then 'event_driven' else 'evergreen' end as seasonality,
 contains(keyword, 'steel') as branded, parent_topic is not null as clustered from sc_c)"""

VOLUME = "coalesce(case when volume > 0 then least(100.0, 100.0 * log10(volume) / log10(100000)) end, 0)"
EASE = "coalesce(100.0 - difficulty, 50)"
PLACE = "case when position = 1 then 100 when position <= 3 then 90 when position <= 10 then 80.0 - (position - 4) * 5 when position <= 20 then 50.0 - (position - 11) * 3 when position <= 50 then greatest(5.0, 25.0 - (position - 21) * 0.5) when position is not null then 5 end"
SERP = "case when len(serp_features) > 0 then 60 else 50 end"
score_of = lambda use: case("query_type", L.INTENT_SCORE[use], 50 if use == "main" else 40)
SCORES = f"""so_a as (select *, cast({VOLUME} as double) as vs, cast({EASE} as double) as ease, cast({PLACE} as double) as place, cast({SERP} as double) as serp, cast({score_of("main")} as double) as im, cast({score_of("quick_win")} as double) as iq from sc),
so as (select *, round(cast(0.35 as double) * vs + 0.25::double * ease + 0.15::double * im + 0.10::double * coalesce(place, 30) + 0.10::double * (case when clustered then 70 else 60 end) + 0.05::double * serp + 1e-9, 1) as score_main,
 round(pow((0.25::double + case when volume is null then 0 else 0.35 end + case when difficulty is null then 0 else 0.25 end + case when position is null then 0.05 else 0.10 end + case when len(serp_features) > 0 then 0.05 else 0.025 end)
  * ({case("source", L.SOURCE_RELIABILITY, 0.7)}) * sqrt(language_confidence::double * intent_confidence::double), 1.0::double / 3), 3) as confidence_main,
 case when wins then round(0.30::double * ease + 0.25::double * vs + 0.15::double * (case when position is null then 80 else coalesce(place, 30) end) + 0.15::double * iq + 6 + 0.05::double * serp + 1e-9, 1) else 0 end as score_quick_win,
 round(21 + 0.20::double * vs + 0.15::double * im + 7.5 + 0.10::double * geo_score + 0.10::double * ease + 1e-9, 1) as score_strategic,
 round(0.30::double * (case when branded then 100 else 30 end) + 0.20::double * geo_score + 0.15::double * aio_score + 0.10::double * vs + 1e-9, 1) as score_aeo from so_a),
ac as (select *, case when wins then 'create' when striking in ('top_page_climb', 'second_page_break') then 'update' when striking = 'third_page_lift' then 'restructure' when score_main < 30 then 'ignore' else 'monitor' end as action from so)"""

#: Parent-topic clusters: cl, and their membership: mb.
CLUSTERS = """pt as (select parent_topic, min(kw_idx) as first, arg_max(kw_idx, coalesce(volume, 0) * 1000000000 - kw_idx) as head_idx, count(*) as size, cast(sum(coalesce(volume, 0)) as bigint) as volume_total from ac where parent_topic is not null group by 1),
cl as (select p.*, row_number() over (order by first) - 1 as cluster_index, k.keyword as head from pt p join ac k on k.kw_idx = p.head_idx),
mb as (select k.kw_idx, c.cluster_index from ac k join cl c on k.parent_topic = c.parent_topic)"""


def chain(*more: str) -> str:
    """WITH clause of the keyword stages (kw, la, en, sc, so, ac, cl, mb) and more."""
    return "with " + ",\n".join([keywords_sql(), language_sql("la", "kw"), intent_sql("en", "la"), SCOPES, SCORES, CLUSTERS, *more]) + "\n"


def texts(*more: str) -> str:
    return "with " + ",\n".join([WHOLE_TEXTS_SQL, language_sql("lt", "fl"), *more]) + "\n"


def monthly(*more: str) -> str:
    return "with " + ",\n".join([SERIES_SQL, *more]) + "\n"


def events_by(unit: str, *more: str) -> str:
    """Sums of events' values by type and unit of time, with positions dense from 0."""
    own = f"sr as (select grp, row_number() over (partition by grp order by m) - 1 as pos, v from (select event_type as grp, date_trunc('{unit}', ts) as m, round(sum(value), 2) as v from events group by 1, 2 having sum(value) is not null) b)"
    return "with " + ",\n".join([own, *more]) + "\n"


def norm_tail(x: str) -> str:
    """The normal tail beyond x >= 0, as numeric.norm_tail writes it."""
    def polynomial(factors):
        out = f"{factors[0]!r}::double"
        for c in factors[1:]:
            out = f"({out} * {x} + {c!r}::double)"
        return out

    fraction = "0.65::double"
    for k in (4, 3, 2, 1):
        fraction = f"({k} / ({x} + {fraction}))"
    return f"case when {x} > {N.LAST_TAIL} then 0 when {x} < {N.FIRST_FRACTION}::double then exp(-{x} * {x} / 2) * {polynomial(N.TAIL_ABOVE)} / {polynomial(N.TAIL_BELOW)} else exp(-{x} * {x} / 2) / ({x} + {fraction}) / 2.506628274631::double end"
