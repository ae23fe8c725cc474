"""Reports, Office documents, stored analyses, strict sources."""

from __future__ import annotations

import io
import json
import xml.etree.ElementTree as ET
import zipfile

import pytest

from tidemark.operators import clusters as C
from tidemark.operators import entities as E
from tidemark.operators import italian as I
from tidemark.operators import summary as S
from tidemark.plans import pipeline
from tidemark.sources import audit, exports, office, reports, sinks

AT = "2026-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    rows = ["how to clean shoes,500,20,1,5,People Also Ask", "red shoes,900,10,1,,shopping", "red shoes sale,100,30,1,12,", "=cmd shoes,50,5,1,3,", "best boots,1000,40,1,8,\"People Also Ask, shopping\""]
    (folder / "a.csv").write_text("Keyword,Volume,KD,Traffic Potential (TP),Current position,SERP features\n" + "\n".join(rows) + "\n")
    return pipeline.from_exports(spark, [folder / "a.csv"], modules=("entity_web", "fan_out_radar", "citation_grid", "click_ceiling"))


def test_report_has_its_sections(run):
    text = reports.report(run.keywords, run.clusters, AT, "label", "client.example")
    heads = [x[3:] for x in text.splitlines() if x.startswith("## ")]
    assert text.startswith("# Keyword report") and heads == [
        "Engagement context", "Corpus summary", "Composite scoring distribution", "Top opportunities", "Recommended actions", "Cluster analysis", "Gap analysis", "AIO and GEO routing", "Methodology and parameters",
    ]
    assert "Total keywords in canonical corpus: 5" in text
    summary = reports.executive_summary(run.keywords, run.clusters, AT)
    assert "Keywords: 5" in summary and len(summary.splitlines()) <= 80
    assert len(reports.executive_summary(run.keywords, run.clusters, AT, most=10).splitlines()) == 10
    briefs = reports.briefs_text(S.briefs(run.keywords, run.clusters, run.membership))
    assert briefs.startswith("# Content briefs") and "- Primary keyword: " in briefs and "- Suggested format: " in briefs
    assert (reports.whole(1234567), reports.real(1.005, 1), reports.change(-2), reports.change(1.25), reports.cut("abcdef", 4), reports.bar(0.5, 4)) == ("1,234,567", "1.0", "-2", "+1.2", "abc…", "██░░")


def test_enriched_columns(run):
    full = reports.enriched(run.keywords, run.clusters, run.membership)
    assert len(full.columns) == 40 and len(reports.enriched(run.keywords, run.clusters, run.membership, minimal=True).columns) == 6
    rows = full.collect()
    assert [r.score_main for r in rows] == sorted((r.score_main for r in rows), reverse=True)
    assert {r.paa_flag for r in rows} == {"yes", ""} and {r.question_flag for r in rows} == {"yes", ""}


def parts(data):
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.namelist() == sorted(z.namelist()) and {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)}
    return {n: ET.fromstring(z.read(n)) for n in z.namelist()}


def referred(found):
    """Every relationship's target and every listed part is a member."""
    names = set(found)
    for n, tree in found.items():
        if n.endswith(".rels"):
            base = n.replace("_rels/", "").rsplit("/", 1)[0] if "/" in n.replace("_rels/", "") else ""
            for r in tree:
                steps = [x for x in f"{base}/{r.get('Target')}".split("/") if x]
                while ".." in steps:
                    k = steps.index("..")
                    del steps[k - 1 : k + 1]
                assert "/".join(steps) in names, (n, r.get("Target"))
    assert all(o.get("PartName", "/_rels/.rels")[1:] in names for o in found["[Content_Types].xml"] if o.get("PartName"))


def test_office_documents(run):
    book = office.workbook({"Overview": run.summary(), "Clusters": run.clusters, "Rows": run.keywords.select("kw_idx", "keyword", "volume", "score_main", "confidence_main")}, "T", AT)
    assert book == office.workbook({"Overview": run.summary(), "Clusters": run.clusters, "Rows": run.keywords.select("kw_idx", "keyword", "volume", "score_main", "confidence_main")}, "T", AT)
    found = parts(book)
    referred(found)
    cells = [c for c in found["xl/worksheets/sheet3.xml"].iter(f"{{{office.SHEET_NS}}}c")]
    texts = {"".join(c.itertext()) for c in cells}
    assert "'=cmd shoes" in texts and "=cmd shoes" not in texts and "900" in texts
    many = parts(office.workbook({"x": run.keywords.select("kw_idx", "keyword", "score_main")}, "T", AT, sheet_rows=3))
    assert sum(len(many[f"xl/worksheets/sheet{k}.xml"][0]) - 1 for k in (1, 2, 3)) == 5  # no row is dropped
    text = parts(office.document("Audit <1>", [("Findings", ["one & two"], (["a", "b"], [[1, None]]))], AT))
    referred(text)
    assert "Audit <1>" in "".join(text["word/document.xml"].itertext())
    deck = parts(office.slides("Deck", [("Clusters", [f"line {k}" for k in range(30)]), ("Notes", [])], AT))
    referred(deck)
    assert len([n for n in deck if n.startswith("ppt/slides/slide")]) == 5
    assert "".join(deck["docProps/core.xml"].itertext()).count("2026-01-01T00:00:00Z") == 2


def test_times_are_strict():
    assert office.w3c_time(office.parse_time("2026-01-01T02:00:00+02:00")) == office.w3c_time(office.parse_time("2026-01-01T00:00:00z")) == AT
    for bad in ("", None, "2026-01-01T00:00:00ZZ", "yesterday", "2026-13-01"):
        with pytest.raises(ValueError):
            office.parse_time(bad)


def test_stored_analysis(spark, run, tmp_path):
    folder = f"{tmp_path}/analysis"
    reports.save_analysis(run, folder, AT, ["/somewhere/else/a.csv", f"{tmp_path}/in/b.csv"], root=str(tmp_path))
    stages, slots, state = reports.load_analysis(spark, folder)
    assert stages["keywords"].count() == 5 and set(slots) == set(run.slots) and slots["bands"].count() == run.slots["bands"].count()
    assert state["inputs"] == ["a.csv", "in/b.csv"] and state["corpus_summary"]["total_keywords"] == 5
    assert json.loads((tmp_path / "analysis/_metadata/input_manifest.json").read_text())["files"] == state["inputs"]
    again = pipeline.Run(stages["keywords"], stages["clusters"], stages["membership"], slots)
    found = reports.comparison(pipeline.compare(again, run))
    assert found["added"]["n"] == found["dropped"]["n"] == 0 and found["deltas"]["rows"][0]["shared"] == 5 and all(r["delta"] == 0 for r in found["intents"]["rows"])
    short = reports.write_comparison(found, f"{tmp_path}/cmp")
    assert "added: 0" in short and json.loads((tmp_path / "cmp/comparison.json").read_text()) == json.loads(json.dumps(found)) and (tmp_path / "cmp/comparison.md").read_text().startswith("# Run comparison")
    known = reports.provenance(f"{tmp_path}/cmp")
    assert reports.verify(f"{tmp_path}/cmp", known) == []
    (tmp_path / "cmp/comparison.md").write_text("x")
    (tmp_path / "cmp/new.txt").write_text("")
    assert reports.verify(f"{tmp_path}/cmp", known) == ["added new.txt", "changed comparison.md"]
    assert sinks.manifest(f"{tmp_path}/cmp", brand={"name": "a"})["brand_sha256"] != sinks.manifest(f"{tmp_path}/cmp")["brand_sha256"]
    (tmp_path / "other").mkdir()
    (tmp_path / "other/analysis.json").write_text("{}")
    with pytest.raises(ValueError):
        reports.load_analysis(spark, f"{tmp_path}/other")


def test_sources_are_strict(spark, tmp_path):
    (tmp_path / "none.csv").write_text("keyword,volume\n")
    with pytest.raises(exports.SourceError, match="no rows"):
        exports.read_exports(spark, [tmp_path / "none.csv"])
    (tmp_path / "lines.csv").write_text('keyword,volume\n"two\nlines",1\nshort\nlong,1,2\nok,3\n')
    assert [tuple(r) for r in audit.ragged(spark, tmp_path / "lines.csv").orderBy("row").collect()] == [(3, 1, 2), (4, 3, 2)]
    found = audit.audit(spark, [tmp_path / "lines.csv"])
    assert "Audit: " in reports.audit_report(found) and json.loads(reports.audit_report(found, "json"))["warnings"] >= 2


def test_gazetteer_and_extractor(spark, tmp_path):
    good = {"language_cues": ["ciao"], "question_pronouns": ["chi"], "intent_markers": {a: ["x"] for a in ("transactional", "commercial", "informational", "navigational")}}
    (tmp_path / "g.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps(good | {"intent_markers": {}}))
    (tmp_path / "c.json").write_text("{")
    words = I.load_gazetteer(str(tmp_path / "g.json"))
    df = spark.createDataFrame([("ciao ciao", 0.4)], "keyword string, language_confidence double")
    assert I.votes(df, words).first().it_score == 2 and I.load_gazetteer() == I.Gazetteer()
    for bad in ("b.json", "c.json", "d.json"):
        with pytest.raises(ValueError):
            I.load_gazetteer(str(tmp_path / bad))
    with pytest.raises(ValueError, match="unknown extractor"):
        E.extractor("other")


def test_settle_writes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = C.settle(spark.range(100).mapInPandas(count, "id long"))
    assert df.count() == df.count() == 100 and seen.value == 100
