"""Observed captures (search-console rows, AI citations) and lookup tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from .exports import SourceError

# Fields of the capture format.
_BODY = """version string, client_domain string, captured_at string, notes string,
 search_console struct<property: string, date_range: string, rows: array<struct<query: string, clicks: string, impressions: string, ctr: string, position: string>>>,
 ai_citations struct<rows: array<struct<query: string, surface: string, observed_on: string, citations: array<struct<domain: string, is_client: boolean>>>>>"""


def number(s: Column) -> Column:
    """A captured number: plain, or per cent as a share; null otherwise."""
    t = F.trim(s)
    value = F.regexp_replace(F.regexp_replace(t, "%$", ""), ",", "").try_cast("double")
    return F.when(t.endswith("%"), value / 100).otherwise(value)


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row: the capture, wrapped or bare. Neither block is an error."""
    inner = ", ".join(p.strip().replace(" ", ": ", 1) for p in _split(_BODY))
    df = spark.read.schema(f"livewire_capture struct<{inner}>, {_BODY}").option("multiLine", True).json(path)
    names = ("version", "client_domain", "captured_at", "notes", "search_console", "ai_citations")
    return df.select(*(F.coalesce(F.col(f"livewire_capture.{n}"), F.col(n)).alias(n) for n in names)).withColumn(
        "checked", F.when(F.col("search_console").isNull() & F.col("ai_citations").isNull(), F.raise_error(F.lit("capture holds neither block")).cast("boolean")).otherwise(True)
    ).where("checked").drop("checked")


def _split(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[at:k])
            at = k + 1
    return [*out, schema[at:]]


def search_rows(capture: DataFrame) -> DataFrame:
    """query, norm, clicks, impressions, ctr, position; clicks and impressions must be non-negative numbers."""
    r = capture.select(F.explode("search_console.rows").alias("r")).select("r.*")
    need = lambda c: F.when(number(F.col(c)) >= 0, number(F.col(c))).otherwise(F.raise_error(F.concat(F.lit(f"search console: bad {c} for "), F.coalesce("query", F.lit("?")))).cast("double"))
    query = F.when(F.trim("query") != "", F.col("query")).otherwise(F.raise_error(F.lit("search console: a row has no query")).cast("string"))
    rate = number(F.col("ctr"))
    return r.select(query.alias("query"), X.norm_key(query).alias("norm"), need("clicks").cast("long").alias("clicks"), need("impressions").cast("long").alias("impressions"), F.when(rate.between(0, 1), rate).alias("ctr"), number(F.col("position")).alias("position"))


def citations(capture: DataFrame) -> DataFrame:
    """query, norm, surface, domain, is_client of each citation; every row needs one with a domain."""
    r = capture.select("client_domain", F.explode("ai_citations.rows").alias("r")).select("client_domain", "r.*")
    named = F.filter("citations", lambda c: F.coalesce(F.trim(c["domain"]), F.lit("")) != "")
    rows = r.select("client_domain", "query", "surface", F.when(F.size(named) > 0, named).otherwise(F.raise_error(F.concat(F.lit("AI citations: no domain for "), F.coalesce("query", F.lit("?"))))).alias("c"))
    each = rows.select("client_domain", "query", "surface", F.explode("c").alias("c")).withColumn("domain", X.domain(F.col("c.domain")))
    client = X.domain(F.col("client_domain"))
    own = F.coalesce(F.col("c.is_client"), F.lit(False)) | F.coalesce((F.col("domain") == client) | F.col("domain").endswith(F.concat(F.lit("."), client)), F.lit(False))
    return each.select("query", X.norm_key(F.col("query")).alias("norm"), "surface", "domain", own.alias("is_client"))


def ctr_table(spark: SparkSession) -> DataFrame:
    rows = [(r, c, "confirmed" if r in L.CTR_CONFIRMED else "interpolated" if r <= L.CTR_MEASURED_TO else "extrapolated") for r, c in L.CTR.items()]
    return spark.createDataFrame(rows, "rank int, ctr double, provenance string")


def synonyms(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, pos, synonym); keys that start with an underscore are notes; a missing file is an empty table."""
    table = L.SYNONYMS if path is None else json.loads(Path(path).read_text()) if Path(path).exists() else {}
    rows = [(k, n, s) for k, v in table.items() if not k.startswith("_") for n, s in enumerate(v)]
    return spark.createDataFrame(rows, "token string, pos int, synonym string")


def brand(path: str) -> dict:
    """A brand's colours and fonts; colours and the font are checked, as they end up in style sheets."""
    import re

    got = json.loads(Path(path).read_text())
    for k, v in got.get("colors", {}).items():
        if not re.fullmatch(r"#[0-9a-fA-F]{6}", v):
            raise SourceError(f"brand: {k} is no colour")
    if not re.fullmatch(r"[\w ,'-]*", got.get("font_family", "")):
        raise SourceError("brand: bad font")
    return got
