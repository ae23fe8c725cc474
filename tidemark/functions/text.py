"""String functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon as L

TOKEN = r"([\p{L}\p{N}_]+)"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(s: Column) -> Column:
    """Canonical composition."""
    return _nfc(s)


def normalize_keyword(s: Column, compose: bool = False) -> Column:
    """Trimmed, lower case, inner white space as single blanks; compose adds NFC (a Python hop, for non-ASCII exports)."""
    s = nfc(s) if compose else s
    return F.trim(F.regexp_replace(F.lower(s), r"(?U)\s+", " "))


def words(s: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(s, r"(?U)\s+"), lambda t: t != "")


def tokens(s: Column) -> Column:
    """Lower-case word tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(s), F.lit(TOKEN), F.lit(1)), lambda t: F.length(t) >= 2)


def norm_key(s: Column) -> Column:
    """Join key: tokens joined by blanks."""
    return F.array_join(tokens(s), " ")


def has_any(s: Column, parts) -> Column:
    """Whether any part is a substring."""
    return F.greatest(*(F.contains(s, F.lit(p)) for p in parts)) if len(parts) > 1 else F.contains(s, F.lit(parts[0]))


def by_language(lang: Column, build) -> Column:
    """build(language) for the row's language, English otherwise."""
    out = build("en")
    for code in ("fr", "de", "es"):
        out = F.when(lang == code, build(code)).otherwise(out)
    return out


def stem(token: Column, lang: str) -> Column:
    """Light suffix stripping; what is left keeps three letters."""
    out = None
    for suffix in L.STEM_SUFFIXES[lang]:
        fits = token.endswith(suffix) & (F.length(token) - len(suffix) >= 3)
        cut = F.left(token, F.length(token) - len(suffix))
        cut = F.concat(cut, F.lit("y")) if suffix == "ies" and lang == "en" else cut
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(F.length(token) <= 3, token).otherwise(out.otherwise(token))


def stems(keyword: Column, lang: Column) -> Column:
    """Stems of tokens that are no stop words and have three letters."""
    def of(code):
        return F.transform(F.filter(words(keyword), lambda t: (F.length(t) >= 3) & ~t.isin(*L.STOP_WORDS[code])), lambda t: stem(t, code))

    return by_language(lang, of)


def domain(url: Column) -> Column:
    """Host of a URL or domain, lower case, without scheme, path and www."""
    s = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(s, r"[/?#].*$", ""), r"^www\.", "")


def same_site(host: Column, client: str) -> Column:
    """Whether a normalised host is the client's domain or below it."""
    return (host == client) | host.endswith("." + client)


def label(s: Column) -> Column:
    """Lower-case letters, digits and single hyphens."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "-"), F.lit("-"))


def coerce_int(s: Column) -> Column:
    """Whole number; separators (comma and dot) and a trailing percent sign go."""
    return F.regexp_replace(F.regexp_replace(F.trim(s), "[,.]", ""), "%+$", "").try_cast("bigint")


def coerce_float(s: Column) -> Column:
    """Number without currency signs and commas; per cent as a share."""
    plain = F.trim(F.regexp_replace(F.trim(s), "[$€£¥]", ""))
    value = F.regexp_replace(F.regexp_replace(plain, "%$", ""), ",", "").try_cast("double")
    return F.when(plain.endswith("%"), value / 100).otherwise(value)


def coerce_difficulty(s: Column) -> Column:
    """Exact decimal; a trailing percent sign goes."""
    return F.trim(F.regexp_replace(F.trim(s), "%+$", "")).try_cast("decimal(38,10)")


def scaled_difficulty(value: Column, highest: Column) -> Column:
    """0 to 100, rounded half up; a column whose highest value is at most 1 is read as shares."""
    whole = F.round(F.when(highest <= 1, value * 100).otherwise(value), 0).cast("int")
    return F.when(whole > 100, 100).otherwise(whole)


def serp_features(s: Column) -> Column:
    """Canonical feature names of a comma-separated list."""
    known = F.create_map(*(F.lit(x) for kv in L.SERP_FEATURES.items() for x in kv))
    def one(item):
        name = F.lower(F.trim(item))
        return F.coalesce(F.element_at(known, name), F.concat(F.lit("_unknown_"), name))

    return F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(F.transform(F.split(s, ","), one))


def safe_cell(s: Column) -> Column:
    """A spreadsheet cell that can't start a formula."""
    return F.when(s.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), s)).otherwise(s)


def escape_html(s: Column) -> Column:
    out = s
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
