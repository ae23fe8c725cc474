"""Reports and stored analyses: Markdown report, executive summary, briefs, comparison, audit report, analysis folder.

Figures are aggregated in Spark; only bounded results (top lists, one row a category) reach the driver as text.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import summary as S
from .sinks import _rounded, md_table

METHODOLOGY = "1"
#: Stage tables of a stored analysis.
STAGES = ("keywords", "clusters", "membership")

# The columns of the enriched table, full and minimal, in order, and where they come from.
COLUMNS = {
    "keyword": "keyword", "keyword_original": "keyword_original", "source": "source", "language": "language", "country": "country", "volume": "volume", "difficulty": "difficulty", "cpc": "cpc",
    "position": "position", "serp_features": "serp_features", "traffic_potential": "traffic_potential", "clicks": "clicks", "impressions": "impressions", "ctr": "ctr", "intent_query_type": "query_type",
    "intent_funnel_stage": "funnel_stage", "intent_modality": "modality", "intent_temporal": "temporal", "cluster_head": "head", "cluster_size": "size", "aio_eligibility": "aio_label",
    "geo_opportunity": "geo_label", "quick_win_flag": "quick_win", "striking_distance_flag": "striking", "branded_flag": "branded", "question_flag": "question_shape", "paa_flag": "paa",
    "seasonality_class": "seasonality", "long_tail_flag": "long_tail", "score_main": "score_main", "score_quick_win": "score_quick_win", "score_strategic": "score_strategic",
    "score_aeo_defensive": "score_aeo", "confidence_main": "confidence_main", "confidence_quick_win": "confidence_quick_win", "confidence_strategic": "confidence_strategic",
    "confidence_aeo_defensive": "confidence_aeo", "recommended_action_class": "action", "source_file": "source_file", "source_row": "source_row",
}
MINIMAL = ("keyword", "score_main", "score_quick_win", "score_strategic", "score_aeo_defensive", "recommended_action_class")


def enriched(keywords: DataFrame, clusters: DataFrame, membership: DataFrame, minimal: bool = False) -> DataFrame:
    """The enriched table (40 columns, or 6), best first; what the corpus lacks is null."""
    held = membership.join(clusters.select("cluster_index", "head", "size"), "cluster_index").select("kw_idx", "head", F.col("size").cast("long").alias("size"))
    df = keywords.join(held, "kw_idx", "left").withColumns({
        "size": F.coalesce("size", F.lit(0)), "head": F.coalesce("head", F.lit("")), "paa": F.array_contains("serp_features", "paa"), "quick_win": F.col("quick_win") == "quick_win",
        "striking": F.when(F.col("striking") != "not_striking", F.col("striking")).otherwise(""),
    })
    flag = lambda c: F.when(c, "yes").otherwise("")
    kinds = dict(df.dtypes)

    def column(name: str, own: str):
        if own not in kinds:
            return F.lit(None).cast("string").alias(name)
        c = F.col(own)
        return (flag(c) if kinds[own] == "boolean" else F.array_join(c, ",") if kinds[own].startswith("array") else c).alias(name)

    return df.orderBy(F.col("score_main").desc(), "kw_idx").select(*(column(n, COLUMNS[n]) for n in (MINIMAL if minimal else COLUMNS)))


# ---------------------------------------------------------------- text


def whole(value) -> str:
    return "" if value is None or value == "" else f"{int(value):,}"


def real(value, digits: int = 2) -> str:
    return "" if value is None or value == "" else f"{float(value):.{digits}f}"


def change(value, digits: int = 1) -> str:
    return "n/a" if value is None else f"{value:+.{digits}f}" if isinstance(value, float) else f"{value:+d}"


def cut(text: str | None, most: int = 80) -> str:
    return (text or "") if len(text or "") <= most else text[: most - 1] + "…"


def bar(share: float, width: int = 40) -> str:
    full = round(share * width)
    return "█" * full + "░" * (width - full)


def _counts(df: DataFrame, column: str) -> list[tuple[str, int]]:
    """A category's counts, largest first: as many rows as there are values of a fixed vocabulary, source or language."""
    got = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("v")).agg(F.count("*").alias("n"))
    return [(r.v, r.n) for r in got.orderBy(F.col("n").desc(), "v").collect()]


def _bars(pairs: list[tuple[str, int]]) -> str:
    total = sum(n for _, n in pairs) or 1
    return "```\n" + "\n".join(f"{name[:28]:<28} {bar(n / total)} {whole(n)} ({100 * n / total:.1f}%)" for name, n in pairs) + "\n```"


def figures(keywords: DataFrame, client: str = "") -> dict:
    """The corpus summary as plain values."""
    (row,) = S.shares(keywords).collect()
    flags = keywords.agg(F.count_if(F.col("quick_win") == "quick_win").alias("q"), F.count_if(F.col("striking").isin(*S.STRIKING)).alias("s"), F.avg("confidence_main").alias("c")).first()
    by = {n: dict(_counts(keywords, c)) for n, c in (("by_source", "source"), ("by_language", "language"), ("by_intent", "query_type"), ("by_action", "action"), ("by_routing", "geo_label"))}
    gaps = {r.gap: {"count": r.n, "samples": r.samples.split("|")} for r in S.gaps(keywords, client).collect()}
    return _rounded({**row.asDict(), "quick_wins": flags.q, "striking": flags.s, "mean_confidence": flags.c or 0.0, **by, "gaps": gaps})


def report(keywords: DataFrame, clusters: DataFrame, pinned_at: str, label: str = "", client: str = "", config=None, top: int = 20) -> str:
    """The Markdown report in its ten sections."""
    f = figures(keywords, client)
    section = lambda name, *parts: f"## {name}\n\n" + "\n\n".join(parts)
    scores = ("score_main", "score_quick_win", "score_strategic", "score_aeo")
    spread = [f"### {s}\n\n{md_table(S.index_percentiles(keywords, s))}" for s in scores]
    best = [f"### {s}\n\n{md_table(S.top(keywords, s, top))}" for s in ("score_main", "score_quick_win", "score_strategic")]
    largest = clusters.orderBy(F.col("volume_total").desc(), "cluster_index").select("cluster_index", "head", "size", "volume_total", "dominant_intent").limit(30)
    listed = [f"### {g}\n\n{whole(x['count'])} keywords" + (f"; first {len(x['samples'])} listed\n\n" if x["count"] > len(x["samples"]) else "\n\n") + "\n".join(f"- {cut(k)}" for k in x["samples"]) for g, x in f["gaps"].items()]
    parts = [
        "# Keyword report",
        section("Engagement context", f"- Engagement label: `{label or '(no label)'}`\n- Run timestamp: {pinned_at}\n- Client domain: {client or '(not set)'}\n- Source tools: {', '.join(sorted(f['by_source']))}\n- Languages observed: {', '.join(sorted(f['by_language'])) or 'n/a'}\n- Methodology version: {METHODOLOGY}"),
        section("Corpus summary", f"**Demand Opportunity Score: {f['demand_opportunity_score']:.1f} / 100.**", f"Total keywords in canonical corpus: {whole(f['total_keywords'])}", *(f"### Distribution by {n}\n\n{_bars(list(f['by_' + n].items()))}" for n in ("source", "language", "intent"))),
        section("Composite scoring distribution", *spread), section("Top opportunities", *best), section("Recommended actions", _bars(list(f["by_action"].items()))),
        section("Cluster analysis", f"{whole(clusters.count())} clusters; the 30 of most volume follow.", md_table(largest)), section("Gap analysis", *(listed or ["No gaps."]), "### Intent presence in corpus\n\n" + ", ".join(sorted(f["by_intent"]))),
        section("AIO and GEO routing", f"- AI Overview share: {100 * f['aio_share']:.1f}%\n- Generative share: {100 * f['geo_share']:.1f}%", _bars(list(f["by_routing"].items()))),
        section("Methodology and parameters", "\n".join(f"- {k}: {v}" for k, v in sorted(vars(config).items())) if config is not None else "Default parameters."),
    ]
    return "\n\n".join(parts) + "\n"


def executive_summary(keywords: DataFrame, clusters: DataFrame, pinned_at: str, label: str = "", client: str = "", most: int = 80) -> str:
    """One page of at most `most` lines; the last one says so where lines are cut."""
    f = figures(keywords, client)
    band, note = ("high", "input completeness and source reliability are good") if f["mean_confidence"] >= 0.75 else ("mixed", "some keywords have partial inputs; sort by confidence") if f["mean_confidence"] >= 0.55 else ("low", "the corpus relies on partial inputs; treat recommendations as research")
    heads = clusters.orderBy(F.col("volume_total").desc(), "cluster_index").limit(3).collect()
    first = S.top(keywords, "score_main", 3).collect()
    lines = [
        f"EXECUTIVE SUMMARY: {label or '(no label)'}", f"Date: {pinned_at[:10]}", f"Demand Opportunity Score: {f['demand_opportunity_score']:.1f} / 100", "", "CORPUS", f"  Keywords: {whole(f['total_keywords'])}",
        f"  Sources: {', '.join(sorted(f['by_source']))}", f"  Languages: {', '.join(sorted(f['by_language']))}", f"  Clusters: {whole(clusters.count())}", "", "OPPORTUNITIES", f"  Quick wins: {whole(f['quick_wins'])}", f"  Striking distance: {whole(f['striking'])}",
        f"  AI Overview share: {100 * f['aio_share']:.1f}%", f"  Generative share: {100 * f['geo_share']:.1f}%", *(f"  Gap {g}: {whole(x['count'])}" for g, x in f["gaps"].items()), "", "TOP CLUSTERS",
        *(f"  {cut(c['head'], 50)}: {whole(c['size'])} keywords, volume {whole(c['volume_total'])}" for c in heads), "", "TOP KEYWORDS", *(f"  {cut(k.keyword, 50)}: {k.score_main:.1f}" for k in first), "", f"CONFIDENCE: {band} ({note})",
    ]
    return "\n".join(lines if len(lines) <= most else [*lines[: most - 1], f"({len(lines) - most + 1} more lines)"]) + "\n"


def briefs_text(briefs: DataFrame, most: int = 15) -> str:
    """Content briefs (see operators.summary.briefs) of the clusters of most volume."""
    rows = briefs.orderBy(F.col("volume_total").desc(), "cluster_index").limit(most).collect()
    if not rows:
        return "# Content briefs\n\nNo clusters formed in this run.\n"
    out = [f"# Content briefs\n\nTop {len(rows)} clusters by total search volume."]
    for r in rows:
        own = [f"- Cluster size: {whole(r['size'])} keywords, {whole(r['volume_total'])} total monthly volume", f"- Dominant intent: {r['intent']}", f"- Suggested format: {r['format']}", f"- Recommended action: {r['action']}", f"- Primary keyword: {r['primary']}"]
        own += [f"- Secondary keywords: {r['secondaries'].replace('|', ', ')}"] if r["secondaries"] else []
        own.append(f"- Questions to answer: {r['questions'].replace('|', '; ') or 'none flagged in this corpus'}")
        out.append(f"## {r['head']}\n\n" + "\n".join(own))
    return "\n\n".join(out) + "\n"


def comparison(parts: dict[str, DataFrame], sample: int = 50) -> dict:
    """A comparison's frames as counts and first rows; `listed` says how many of `n` rows are there."""
    out = {}
    for name, df in parts.items():
        rows = [r.asDict() for r in df.orderBy(*df.columns).limit(sample).collect()]
        out[name] = {"n": df.count(), "listed": len(rows), "rows": _rounded(rows)}
    return out


def write_comparison(found: dict, folder: str, title: str = "Run comparison") -> str:
    """comparison.json and comparison.md in the folder; returns the short form for the terminal."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    (root / "comparison.json").write_text(json.dumps(found, sort_keys=True, indent=2, ensure_ascii=False) + "\n")
    parts = [f"# {title}"]
    for name, x in found.items():
        names = list(x["rows"][0]) if x["rows"] else []
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
        table = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in x["rows"])] if names else ["None."]
        parts.append(f"## {name}\n\n{whole(x['n'])} rows" + (f", first {x['listed']} listed" if x["n"] > x["listed"] else "") + "\n\n" + "\n".join(table))
    (root / "comparison.md").write_text("\n\n".join(parts) + "\n")
    return "\n".join(f"{name}: {whole(x['n'])}" for name, x in found.items()) + "\n"


def audit_report(findings: DataFrame, form: str = "human") -> str:
    """An audit's findings (bounded by files and caps) as text or JSON, worst first."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    rows = [r.asDict() for r in findings.orderBy(rank, "category", F.col("file").asc_nulls_first(), F.col("row").asc_nulls_first()).collect()]
    count = lambda s: sum(r["severity"] == s for r in rows)
    status = "FAIL" if count("CRITICAL") else "WARN" if count("WARNING") else "PASS"
    if form == "json":
        return json.dumps({"status": status, "critical": count("CRITICAL"), "warnings": count("WARNING"), "findings": rows}, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
    place = lambda r: (f" ({r['file']}" + (f", row {r['row']}" if r["row"] is not None else "") + ")") if r["file"] else ""
    return "\n".join([f"Audit: {status}", f"{count('CRITICAL')} critical, {count('WARNING')} warnings", *(f"[{r['severity']}] {r['category']}: {r['message']}{place(r)}" for r in rows)]) + "\n"


# ---------------------------------------------------------------- stored analyses


#: What a serialised record leaves out.
LEFT_OUT = ("parent_topic", "competitor_url", "domain_rank", "intent_label_raw")


def serialised(df: DataFrame) -> DataFrame:
    """(kw_idx, record): each keyword as one JSON object in order of its fields' names, without LEFT_OUT; null fields are left out, doubles have 6 places at most."""
    kept = sorted(c for c in df.columns if c not in (*LEFT_OUT, "kw_idx"))
    real = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select("kw_idx", F.to_json(F.struct(*(F.round(c, 6).alias(c) if c in real else F.col(c) for c in kept))).alias("record"))


def portable(path: str, root: str) -> str:
    """A path below the root relative to it, any other by its bare name: no prefix of a machine stays."""
    try:
        return Path(path).resolve().relative_to(Path(root).resolve()).as_posix()
    except (ValueError, OSError):
        return Path(path).name


def save_analysis(run, folder: str, pinned_at: str, inputs=(), config=None, root: str = "", client: str = "", fingerprint: str = "") -> dict:
    """analysis.json, _metadata/, the stage tables as Parquet and the serialised records as lines of JSON, in any store that Spark reaches.

    The JSON files are small: figures, parameters, and one entry for each input file.
    """
    for name in STAGES:
        getattr(run, name).write.mode("overwrite").parquet(f"{folder}/stages/{name}")
    for name, df in run.slots.items():
        df.write.mode("overwrite").parquet(f"{folder}/stages/slot_{name}")
    serialised(run.keywords).select("record").write.mode("overwrite").text(f"{folder}/records")
    files = [portable(str(p), root) for p in inputs]
    parameters = {k: list(v) if isinstance(v, tuple) else v for k, v in (vars(config) if config is not None else {}).items()}
    state = {"run_metadata": {"timestamp": pinned_at, "methodology_version": METHODOLOGY}, "corpus_summary": figures(run.keywords, client), "slots": sorted(run.slots), "inputs": files}
    texts = {
        "analysis.json": json.dumps(state, sort_keys=True, indent=2, ensure_ascii=False) + "\n", "_metadata/run_config.json": json.dumps(parameters, sort_keys=True, indent=2) + "\n",
        "_metadata/input_manifest.json": json.dumps({"files": files, "sha256": fingerprint}, sort_keys=True, indent=2) + "\n", "_metadata/methodology_version.txt": METHODOLOGY + "\n",
    }
    spark = run.keywords.sparkSession
    for name, text in texts.items():
        _write(spark, f"{folder}/{name}", text)
    return state


def load_analysis(spark: SparkSession, folder: str):
    """(stages, slots, state) of a stored analysis; an error where it is none."""
    state = json.loads(_read(spark, f"{folder}/analysis.json"))
    if not {"run_metadata", "corpus_summary", "slots"} <= set(state):
        raise ValueError(f"not an analysis: {folder}")
    table = lambda name: spark.read.parquet(f"{folder}/stages/{name}")
    return {n: table(n) for n in STAGES}, {n: table(f"slot_{n}") for n in state["slots"]}, state


def _file_system(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, jpath = _file_system(spark, path)
    out = fs.create(jpath, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str:
    (row,) = spark.read.text(path, wholetext=True).collect()
    return row.value


def provenance(folder: str) -> dict:
    """Bytes and digest of each file below a local folder, by relative path, and one digest of all: what a proof is checked by."""
    root = Path(folder)
    files = {p.relative_to(root).as_posix(): {"bytes": p.stat().st_size, "sha256": hashlib.sha256(p.read_bytes()).hexdigest()} for p in sorted(root.rglob("*")) if p.is_file()}
    return {"files": files, "sha256": hashlib.sha256(json.dumps(files, sort_keys=True).encode()).hexdigest()}


def verify(folder: str, known: dict) -> list[str]:
    """What differs from a known provenance: missing, added and changed files."""
    now, then = provenance(folder)["files"], known["files"]
    return [f"missing {n}" for n in sorted(then.keys() - now.keys())] + [f"added {n}" for n in sorted(now.keys() - then.keys())] + [f"changed {n}" for n in sorted(now.keys() & then.keys()) if now[n] != then[n]]
