"""Keyword exports, monthly series and observed captures as DataFrames.

Files are sniffed on the driver (encoding, separator, header); the data are read by Spark, a file by as many tasks as it
has splits (see splits). Row order is data: kw_idx counts rows by (file order, row), from the file's own row numbers and
not from partition ids.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from .splits import read_cells

#: Files that can't be split (UTF-16) may be no larger; the audit calls larger files oversized.
MOST_BYTES = 500 * 1024 * 1024
SNIFF_BYTES = 4096
SEPARATORS = (",", ";", "\t", "|")
# Short Italian month names, in calendar order.
MONTHS = "gen feb mar apr mag giu lug ago set ott nov dic".split()
FIELDS = ("keyword", "volume", "difficulty", "cpc", "position", "serp_features", "traffic_potential", "intent_label_raw", "country", "parent_topic", "competitor_url", "clicks", "impressions", "ctr", "domain_rank")


class SourceError(ValueError):
    """An input that can't be read."""


@dataclass(frozen=True)
class Sniffed:
    path: str
    encoding: str
    separator: str
    headers: tuple[str, ...]
    line_break: str = "\n"


def expand(inputs, suffixes=(".csv", ".tsv"), unique: bool = True) -> list[Path]:
    """Files in order; folders give their files with the suffixes, sorted. Missing or empty inputs are errors."""
    out: list[Path] = []
    for item in map(Path, inputs):
        if item.is_dir():
            out += sorted(p for p in item.iterdir() if p.suffix.lower() in suffixes)
        elif item.is_file():
            out.append(item)
        else:
            raise SourceError(f"no such path: {item}")
    if unique:
        out = sorted({p.resolve() for p in out}, key=lambda p: p.as_posix())
    if not out:
        raise SourceError("no inputs")
    return out


def encoding_of(head: bytes) -> str:
    """UTF-8-BOM, UTF-16, UTF-8 or ISO-8859-1, from the first bytes."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "utf-8" if e.start > len(head) - 4 and len(head) == SNIFF_BYTES else "iso-8859-1"
    return "utf-8"


def separator_of(lines: list[str]) -> str:
    """The candidate whose count in line 1 recurs in most of the first ten lines; earlier candidates win ties."""
    def steady(c):
        n = lines[0].count(c) if lines else 0
        return sum(line.count(c) == n for line in lines[:10]) if n else 0

    best = max(SEPARATORS, key=steady)
    return best if steady(best) else ","


def sniff(path: str | Path) -> Sniffed:
    path = Path(path)
    with path.open("rb") as f:
        raw = f.read(1 << 20)
    encoding = encoding_of(raw[:SNIFF_BYTES])
    if encoding == "utf-16" and path.stat().st_size > MOST_BYTES:
        raise SourceError(f"{path}: over {MOST_BYTES} bytes of UTF-16, which one task has to read")
    lines = raw.decode(encoding, "replace").splitlines()
    if not lines or not lines[0].strip():
        raise SourceError(f"{path}: no header")
    separator = separator_of(lines)
    import csv

    return Sniffed(str(path), encoding, separator, tuple(next(csv.reader([lines[0]], delimiter=separator))), "\r" if b"\r" in raw and b"\n" not in raw else "\n")


def tool_of(headers) -> str:
    names = {h.strip().lower() for h in headers}
    for tool, signature in L.TOOL_SIGNATURES:
        if signature <= names:
            return tool
    if "keyword" in names:
        return "generic"
    raise SourceError(f"unknown headers: {sorted(names)}")


def is_seozoom(headers) -> bool:
    names = {h.strip().lower() for h in headers}
    return {"keyword", "concorrenza"} <= names


SEOZOOM = {"keyword": "keyword", "intent": "intent_label_raw", "vol": "volume", "concorrenza": "difficulty", "cpc": "cpc"}


def mapping_of(tool: str, override: dict[str, str] | None = None) -> dict[str, str]:
    return {**L.TOOL_COLUMNS.get(tool, L.TOOL_COLUMNS["generic"]), **{k.lower(): v for k, v in (override or {}).items()}}


def show_mapping(spark: SparkSession, paths) -> DataFrame:
    """(file, tool, header, field) of each input's columns."""
    rows = []
    for p in map(sniff, paths):
        tool = tool_of(p.headers)
        rows += [(p.path, tool, h, mapping_of(tool).get(h.strip().lower())) for h in p.headers]
    return spark.createDataFrame(rows, "file string, tool string, header string, field string")


def raw_rows(spark: SparkSession, s: Sniffed) -> DataFrame:
    """The file's cells as strings, with source_row (the header is row 1), n_cells, and the block of the file that holds them; a file without rows is an error.

    Only UTF-16, whose line breaks can't be found from the middle of a file, is read by one task from start to end.
    """
    if s.encoding == "utf-16":
        schema = ", ".join(f"c{k} string" for k in range(len(s.headers)))
        dialect = {"header": True, "enforceSchema": True, "sep": s.separator, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-16"}
        rows = spark.read.options(**dialect).schema(schema).csv(s.path).withColumn("source_row", F.monotonically_increasing_id() + 2)
        rows, n = rows.withColumns({"block": F.lit(0).cast("long"), "n_cells": F.lit(len(s.headers))}), rows.limit(1).count() + 1
    else:
        rows, n = read_cells(spark, s.path, s.separator, {"utf-8-sig": "utf-8"}.get(s.encoding, s.encoding), len(s.headers), s.line_break)
    if n < 2:
        raise SourceError(f"{s.path}: no rows")
    return rows


def _field(s: Sniffed, mapping: dict[str, str], name: str) -> Column:
    """The last mapped column with a non-empty cell."""
    own = [f"c{k}" for k, h in enumerate(s.headers) if mapping.get(h.strip().lower()) == name]
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in reversed(own))) if own else F.lit(None).cast("string")


def canonical(spark: SparkSession, path, order: int, tool: str | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """One file's rows in canonical form, without kw_idx."""
    s = sniff(path)
    seozoom = is_seozoom(s.headers)
    tool = "generic" if override or seozoom else tool or tool_of(s.headers)
    mapping = {**mapping_of(tool, override), **(SEOZOOM if seozoom else {})}
    cells = raw_rows(spark, s).select("source_row", "block", *(_field(s, mapping, f).alias(f) for f in FIELDS))
    c = {f: F.col(f) for f in FIELDS}
    ascii_ = ~c["keyword"].rlike(r"[^\x00-\x7F]")
    plain = X.normalize_keyword(c["keyword"])
    keyword = F.when(ascii_, plain).otherwise(X.normalize_keyword(c["keyword"], compose=True))
    position = X.coerce_int(c["position"])
    rows = cells.select(
        F.lit(order).alias("file_order"), "block", F.lit(str(path)).alias("source_file"), F.col("source_row").cast("int"), F.lit(tool).alias("source"), keyword.alias("keyword"), F.trim(c["keyword"]).alias("keyword_original"),
        "country", X.coerce_int(c["volume"]).alias("volume"), X.coerce_difficulty(c["difficulty"]).alias("d"), X.coerce_float(c["cpc"]).alias("cpc"), F.when(position <= 100, position).cast("int").alias("position"),
        X.serp_features(c["serp_features"]).alias("serp_features"), X.coerce_int(c["traffic_potential"]).alias("traffic_potential"), "intent_label_raw", X.coerce_int(c["clicks"]).alias("clicks"),
        X.coerce_int(c["impressions"]).alias("impressions"), X.coerce_float(c["ctr"]).alias("ctr"), "parent_topic", "competitor_url", X.coerce_int(c["domain_rank"]).alias("domain_rank"),
    ).where((F.col("keyword") != "") & (F.length("keyword") <= 200))
    top = rows.agg(F.max("d").alias("top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("difficulty", X.scaled_difficulty(F.col("d"), F.col("top"))).drop("d", "top")  # one row of one number


def read_exports(spark: SparkSession, inputs, override: dict[str, str] | None = None) -> DataFrame:
    """All inputs as one corpus (duplicates across sources stay), numbered by (file, row) from 0.

    One SEOZoom export among them marks every file's source as generic, as a custom mapping does.
    """
    paths = expand(inputs)
    if any(is_seozoom(sniff(p).headers) for p in paths):
        override = override or {}
        parts = [canonical(spark, p, k, override=SEOZOOM | override) for k, p in enumerate(paths)]
    else:
        parts = [canonical(spark, p, k, override=override) for k, p in enumerate(paths)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = every.groupBy("file_order", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each split of a file
    offsets = counts.select("file_order", "block", before.alias("before"))
    in_block = F.row_number().over(Window.partitionBy("file_order", "block").orderBy("source_row"))  # a split
    return every.withColumn("r", in_block).join(offsets, ["file_order", "block"]).withColumn("kw_idx", F.col("before") + F.col("r") - 1).drop("before", "r", "file_order", "block")


def _number(cell: Column, what: str) -> Column:
    value = F.regexp_replace(F.trim(cell), ",", ".").try_cast("double")
    return F.when(F.coalesce(F.trim(cell), F.lit("")) == "", None).when(value.isNull() | (value < 0), F.raise_error(F.concat(F.lit(f"{what}: bad value "), cell)).cast("double")).otherwise(value)


def _series(spark: SparkSession, s: Sniffed, columns: list[tuple[str, str]], keyword: str) -> DataFrame:
    """(norm_kw, period, value); of repeated keywords the last row holds. columns: (cell column, period)."""
    cells = raw_rows(spark, s)
    last = cells.withColumn("norm_kw", X.norm_key(F.col(keyword))).where(F.col("norm_kw") != "").groupBy("norm_kw").agg(F.max_by(F.struct(*(c for c, _ in columns)), "source_row").alias("v"))
    points = F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.col(f"v.{c}").alias("cell")) for c, p in columns)))
    return last.select("norm_kw", points.alias("x")).select("norm_kw", "x.period", _number(F.col("x.cell"), Path(s.path).name).alias("value"))


def read_series(spark: SparkSession, path) -> DataFrame:
    """A series CSV: a keyword column and at least two YYYY-MM columns."""
    s = sniff(path)
    months = sorted((h.strip(), f"c{k}") for k, h in enumerate(s.headers) if re.fullmatch(r"\d{4}-\d{2}", h.strip()))
    if len(months) < 2:
        raise SourceError(f"{path}: needs two month columns at least")
    named = [f"c{k}" for k, h in enumerate(s.headers) if h.strip().lower() == "keyword"]
    return _series(spark, s, [(c, p) for p, c in months], named[0] if named else "c0")


def read_month_columns(spark: SparkSession, paths, year: int | None = None) -> DataFrame | None:
    """The twelve Italian month columns of SEOZoom exports, unpivoted; None without two of them. Periods: YYYY-MM or mNN."""
    out, seen = None, None
    for s in map(sniff, paths):
        if not is_seozoom(s.headers):
            continue
        columns = [(f"c{k}", MONTHS.index(h.strip().lower()[:3])) for k, h in enumerate(s.headers) if h.strip().lower()[:3] in MONTHS]
        columns.sort(key=lambda x: x[1])
        if len(columns) < 2:
            continue
        found = [m for _, m in columns]
        if seen not in (None, found):
            raise SourceError("exports have different month columns")
        seen = found
        keyword = next(f"c{k}" for k, h in enumerate(s.headers) if h.strip().lower() == "keyword")
        part = _series(spark, s, [(c, f"{year}-{m + 1:02d}" if year else f"m{m + 1:02d}") for c, m in columns], keyword)
        out = part if out is None else out.unionByName(part)
    return out


def fingerprint(paths) -> str:
    """One digest of all inputs, whatever their order: path, size and bytes of each."""
    each = []
    for p in sorted(map(Path, paths), key=lambda p: p.as_posix()):
        h = hashlib.sha256(f"{p.as_posix()}\0{p.stat().st_size}\0".encode())
        with p.open("rb") as f:
            while block := f.read(1 << 16):
                h.update(block)
        each.append(h.hexdigest())
    return hashlib.sha256("\n".join(each).encode()).hexdigest()


def fingerprints(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes, sha256) of files in any store that Spark reads."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
