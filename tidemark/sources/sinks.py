"""Outputs: enriched CSV, run state, Markdown and HTML reports, content-addressed manifest, normalised archives."""

from __future__ import annotations

import csv
import hashlib
import html
import io
import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Slots of the run-state format, in order.
SLOTS = ("language_layer", "entity_web", "fan_out_radar", "demand_pulse", "citation_grid", "click_ceiling", "live_wire", "output_forge")
VERSION = "0.2.0"


def flat(df: DataFrame) -> DataFrame:
    """Rows for a spreadsheet, best first: lists joined, flags as yes or empty, no cell that starts a formula."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith("array"):
            c = F.array_join(c, ",")
        elif kind == "boolean":
            c = F.when(c, "yes").otherwise("")
        elif kind == "string":
            c = X.safe_cell(c)
        out.append(c.alias(name))
    ordered = df.select(*out)
    return ordered.orderBy(F.col("score_main").desc(), "kw_idx") if {"score_main", "kw_idx"} <= set(df.columns) else ordered


def write_csv(df: DataFrame, path: str, line_end: str = "\r\n", bom: bool = True) -> None:
    """One file, row by row through the driver (toLocalIterator holds one partition)."""
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        w = csv.writer(f, lineterminator=line_end)
        w.writerow(df.columns)
        for row in flat(df).toLocalIterator():
            w.writerow(["" if v is None else v for v in row])


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each stage as Parquet: the form for large runs."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def _rounded(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, dict):
        return {k: _rounded(v) for k, v in x.items()}
    return [_rounded(v) for v in x] if isinstance(x, (list, tuple)) else x


def run_state(engine: dict, modules: dict[str, object], pinned_at: str) -> dict:
    """A run's state from small, already collected results; unknown slots are errors, missing ones null."""
    if extra := set(modules) - set(SLOTS):
        raise ValueError(f"unknown modules: {sorted(extra)}")
    return {"suite": {"version": VERSION, "generated_at": pinned_at}, "engine": _rounded(engine), "modules": {s: _rounded(modules.get(s)) for s in SLOTS}}


def validate(state: dict) -> None:
    if set(state) != {"suite", "engine", "modules"} or set(state["modules"]) != set(SLOTS) or not isinstance(state["engine"], dict):
        raise ValueError("not a run state")


def save_state(state: dict, path: str) -> None:
    validate(state)
    Path(path).write_text(json.dumps(state, sort_keys=True, indent=2, ensure_ascii=False) + "\n")


def load_state(path: str) -> dict:
    state = json.loads(Path(path).read_text())
    validate(state)
    return state


def md_table(df: DataFrame, most: int = 50) -> str:
    """A Markdown table of the first rows (a report's top list); a last line says so where there are more."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    rows = df.limit(most + 1).collect()
    more = [f"\nOnly the first {most} rows are listed."] if len(rows) > most else []
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]), *more])


def report(title: str, sections: dict[str, DataFrame], pinned_at: str) -> str:
    return "\n\n".join([f"# {title}", f"Generated: {pinned_at}", *(f"## {name}\n\n{md_table(df)}" for name, df in sections.items())]) + "\n"


def summary_text(lines: list[str], most: int = 80) -> str:
    return "\n".join(lines[:most]) + "\n"


def bar_chart(values: list[tuple[str, float]], width: int = 400) -> str:
    """An inline SVG bar chart."""
    top = max((v for _, v in values), default=0) or 1
    bars = "".join(f'<text x="0" y="{20 * k + 14}">{html.escape(n)}</text><rect x="160" y="{20 * k + 3}" height="14" width="{v / top * width:.1f}"/>' for k, (n, v) in enumerate(values))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width + 170}" height="{20 * len(values) + 6}">{bars}</svg>'


def dashboard(title: str, sections: dict[str, DataFrame], charts: dict[str, list[tuple[str, float]]], brand: dict | None = None) -> str:
    """A self-contained HTML page: charts and tables, all text escaped."""
    brand = brand or {}
    style = f"body{{font-family:{brand.get('font_family', 'sans-serif')};color:{brand.get('colors', {}).get('text', '#222222')}}}rect{{fill:{brand.get('colors', {}).get('primary', '#336699')}}}td,th{{padding:2px 8px;text-align:left}}"
    parts = [f"<h2>{html.escape(n)}</h2>{bar_chart(v)}" for n, v in charts.items()]
    for name, df in sections.items():
        listed = df.limit(51).collect()
        rows = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}</td>" for v in r) + "</tr>" for r in listed[:50])
        more = "<p>Only the first 50 rows are listed.</p>" if len(listed) > 50 else ""
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>{rows}</table>{more}")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>\n'


def json_island(data) -> str:
    """JSON that can stand inside a script element."""
    return json.dumps(data, sort_keys=True).replace("<", "\\u003c")


def manifest(folder: str, skipped: dict[str, str] | None = None, brand: dict | None = None) -> dict:
    """Bytes and digest of each artefact, why formats are missing, and a digest of the brand they were drawn with."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())
    own = hashlib.sha256(json.dumps(brand or {}, sort_keys=True).encode()).hexdigest()
    return {"files": [{"name": p.name, "bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in files], "skipped": dict(sorted((skipped or {}).items())), "brand_sha256": own}


def normalise_zip(data: bytes) -> bytes:
    """The same archive with sorted members and pinned dates: equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        for name in sorted(a.namelist()):
            b.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), a.read(name), zipfile.ZIP_DEFLATED)
    return out.getvalue()
