"""Audit of export files and parameters: findings as a DataFrame (severity, category, message, file, row)."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as R
from . import exports

SCHEMA = "severity string, category string, message string, file string, row int"
DOMAIN = re.compile(r"[a-z0-9.-]+\.[a-z]{2,}")
#: Rows named for each file and kind of finding.
NAMED = {"row_column_mismatch": 5, "keyword_too_long": 3}
LARGE = 0.8


def parameters(brands=(), client_domain: str = "") -> list[tuple]:
    out = []
    for b in brands:
        if not b.strip():
            out.append(("WARNING", "empty_brand", "a brand is empty", None, None))
        elif len(b.strip()) < 3:
            out.append(("WARNING", "short_brand", f"brand {b.strip()!r} is very short", None, None))
    if client_domain and not DOMAIN.fullmatch(client_domain):
        out.append(("WARNING", "malformed_domain", f"{client_domain!r} is no domain", None, None))
    return out


def file_checks(path: Path, most_bytes: int = exports.MOST_BYTES) -> list[tuple]:
    """Checks of one file that need its first bytes only."""
    out = []
    add = lambda severity, category, message: out.append((severity, category, message, str(path), None))
    if not path.exists():
        add("CRITICAL", "file_missing", "no such file")
    elif not path.is_file():
        add("CRITICAL", "not_a_file", "not a file")
    elif path.stat().st_size == 0:
        add("CRITICAL", "empty_file", "the file is empty")
    elif path.stat().st_size > most_bytes:
        add("CRITICAL", "oversized_file", f"over {most_bytes} bytes")
    if out:
        return out
    if path.stat().st_size > LARGE * most_bytes:
        add("WARNING", "large_file", "near the size limit")
    with path.open("rb") as f:
        head = f.read(1 << 16)
    encoding = exports.encoding_of(head[: exports.SNIFF_BYTES])
    if encoding in ("utf-16", "iso-8859-1"):
        add("WARNING", {"utf-16": "encoding_utf16", "iso-8859-1": "encoding_latin1"}[encoding], f"read as {encoding}")
    lines = [x for x in head.decode(encoding, "replace").splitlines()[:10] if x.strip()]
    if not lines:
        add("CRITICAL", "no_header", "no header")
        return out
    separator = exports.separator_of(lines)
    if sum(x.count(separator) == lines[0].count(separator) for x in lines) < 8:
        add("WARNING", "separator_inconsistent", f"separator {separator!r} doesn't recur in the first lines")
    names = [h.strip().strip('"') for h in lines[0].split(separator)]
    if any(not h for h in names):
        add("WARNING", "empty_header", "a header cell is empty")
    if not {h.lower() for h in names} & {"keyword", "top queries", "query"}:
        add("CRITICAL", "no_keyword_column", "no keyword column")
    return out


def ragged(spark: SparkSession, path: Path) -> DataFrame:
    """Rows whose number of cells isn't the header's (row, cells, expected), as the scan finds and numbers them."""
    s = exports.sniff(path)
    rows = exports.raw_rows(spark, s).where(F.col("n_cells") != len(s.headers))
    return rows.select(F.col("source_row").cast("int").alias("row"), F.col("n_cells").alias("cells"), F.lit(len(s.headers)).alias("expected"))


def audit(spark: SparkSession, inputs, brands=(), client_domain: str = "", most_bytes: int = exports.MOST_BYTES) -> DataFrame:
    """All findings of the given files and parameters. The scan itself has no limit of size; most_bytes is the audit's."""
    found = parameters(brands, client_domain)
    if not inputs:
        found.append(("CRITICAL", "no_inputs", "no inputs", None, None))
    out = None
    for path in map(Path, inputs):
        own = file_checks(path, most_bytes)
        found += own
        if any(f[0] == "CRITICAL" for f in own):
            continue
        name = F.lit(str(path))
        bad = ragged(spark, path)
        n = bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("WARNING").alias("severity"), F.lit("inconsistent_column_count").alias("category"), F.format_string("%d rows", "n").alias("message"), name.alias("file"), F.lit(None).cast("int").alias("row"))
        each = bad.orderBy("row").limit(NAMED["row_column_mismatch"]).select(F.lit("WARNING").alias("severity"), F.lit("row_column_mismatch").alias("category"), F.format_string("%d cells for %d", "cells", "expected").alias("message"), name.alias("file"), "row")
        raw = exports.canonical(spark, path, 0)
        rows = R.findings(R.audit_rows(raw)).select("severity", "category", F.format_string("%d rows", "n").alias("message"), name.alias("file"), F.lit(None).cast("int").alias("row"))
        part = n.unionByName(each).unionByName(rows)
        out = part if out is None else out.unionByName(part)
    given = spark.createDataFrame(found, SCHEMA)
    return given if out is None else given.unionByName(out)


def exit_code(findings: DataFrame) -> int:
    """0 without findings, 1 with a critical one, 2 with warnings only."""
    levels = {r.severity for r in findings.select("severity").distinct().collect()}
    return 1 if "CRITICAL" in levels else 2 if levels else 0
