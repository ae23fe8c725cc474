"""Office documents written as plain OOXML archives: workbook, text document and slides, without their libraries.

Members are sorted and dated 1980-01-01, so that equal content gives equal bytes. Rows come through the driver one by one;
a workbook goes on in further sheets where a sheet is full, so that no row is dropped.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from datetime import UTC, datetime
from html import escape

from pyspark.sql import DataFrame

from .sinks import flat, normalise_zip

#: Rows of a sheet, by the format.
SHEET_ROWS = 1_048_576
#: Lines of a slide.
SLIDE_LINES = 12

# Namespaces and types of the OOXML format.
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SLIDE_NS = "http://schemas.openxmlformats.org/presentationml/2006/main"
DRAW_NS = "http://schemas.openxmlformats.org/drawingml/2006/main"
TYPE = "application/vnd.openxmlformats-officedocument."
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Number formats: whole numbers, shares and scores.
FORMATS = {"whole": (1, "#,##0"), "real": (2, "0.00"), "share": (3, "0.0%")}


def parse_time(value: str | None) -> datetime:
    """A strict ISO 8601 time; one trailing Z means UTC. Anything else is an error, so that no date is invented."""
    text = (value or "").strip()
    if text[-1:] in ("Z", "z"):
        text = text[:-1] + "+00:00"
    if not text or "z" in text.lower():
        raise ValueError(f"not an ISO 8601 time: {value!r}")
    return datetime.fromisoformat(text)


def w3c_time(at: datetime) -> str:
    """In UTC as core properties write it; a time without a zone is one of UTC."""
    return (at.replace(tzinfo=UTC) if at.tzinfo is None else at.astimezone(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def _text(value) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))


def _relations(items: Iterable[tuple[str, str, str]]) -> str:
    return HEAD + f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{k}" Type="{kind}" Target="{target}"/>' for k, kind, target in items) + "</Relationships>"


def _package(main: str, main_type: str, members: dict[str, str], types: dict[str, str], title: str, pinned_at: str) -> bytes:
    """The archive of the members, with content types, relationships and core properties of the pinned time."""
    at = w3c_time(parse_time(pinned_at))
    core = (
        HEAD + f'<cp:coreProperties xmlns:cp="{PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:dcterms="http://purl.org/dc/terms/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'
        f'<dc:title>{_text(title)}</dc:title><dcterms:created xsi:type="dcterms:W3CDTF">{at}</dcterms:created><dcterms:modified xsi:type="dcterms:W3CDTF">{at}</dcterms:modified></cp:coreProperties>'
    )
    parts = {main: main_type, **types}
    listed = "".join(f'<Override PartName="/{p}" ContentType="{TYPE}{t}+xml"/>' for p, t in parts.items())
    members = members | {
        "[Content_Types].xml": HEAD + f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{listed}<Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": _relations([("rId1", f"{OFFICE}/officeDocument", main), ("rId2", f"{PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")]), "docProps/core.xml": core,
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return normalise_zip(out.getvalue())


def _column(k: int) -> str:
    name = ""
    while k >= 0:
        name, k = chr(65 + k % 26) + name, k // 26 - 1
    return name


def _cell(at: str, value, style: int) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}" s="{style}"><v>{value!r}</v></c>' if value == value and abs(value) != float("inf") else ""
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>'


def _style(name: str, kind: str) -> int:
    if re.search("share|authority|coverage|confidence|ratio", name) and kind in ("double", "float"):
        return FORMATS["share"][0]
    return FORMATS["whole"][0] if kind in ("int", "bigint", "smallint") else FORMATS["real"][0]


def workbook(sheets: dict[str, DataFrame], title: str, pinned_at: str, sheet_rows: int = SHEET_ROWS) -> bytes:
    """XLSX of the frames: header row, numbers as numbers with a format by kind, no cell that starts a formula."""
    made: list[tuple[str, str]] = []
    for name, df in sheets.items():
        rows, styles, part = [], [_style(n, t) for n, t in df.dtypes], 0

        def close():
            number = f" {part}" if part else ""
            made.append((re.sub(r"[\[\]:*?/\\]", " ", name)[: 31 - len(number)] + number, "".join(rows)))

        def add(values):
            r = len(rows) + 1
            rows.append(f'<row r="{r}">' + "".join(_cell(f"{_column(k)}{r}", v, s) for k, (v, s) in enumerate(zip(values, styles, strict=True))) + "</row>")

        add(df.columns)
        for row in flat(df).toLocalIterator():
            if len(rows) == sheet_rows:
                close()
                part += 1
                rows = []
                add(df.columns)
            add(row)
        close()
    sheet = lambda body: HEAD + f'<worksheet xmlns="{SHEET_NS}"><sheetData>{body}</sheetData></worksheet>'
    members = {f"xl/worksheets/sheet{k}.xml": sheet(body) for k, (_, body) in enumerate(made, 1)}
    formats = "".join(f'<numFmt numFmtId="{163 + k}" formatCode="{escape(code)}"/>' for k, code in FORMATS.values())
    styles_ = "".join(f'<xf numFmtId="{163 + k}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for k, _ in FORMATS.values())
    members["xl/styles.xml"] = HEAD + f'<styleSheet xmlns="{SHEET_NS}"><numFmts count="{len(FORMATS)}">{formats}</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FORMATS) + 1}"><xf/>{styles_}</cellXfs></styleSheet>'
    listed = "".join(f'<sheet name="{_text(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(made, 1))
    members["xl/workbook.xml"] = HEAD + f'<workbook xmlns="{SHEET_NS}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>'
    members["xl/_rels/workbook.xml.rels"] = _relations([(f"rId{k}", f"{OFFICE}/worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(made) + 1)] + [(f"rId{len(made) + 1}", f"{OFFICE}/styles", "styles.xml")])
    types = {f"xl/worksheets/sheet{k}.xml": "spreadsheetml.worksheet" for k in range(1, len(made) + 1)} | {"xl/styles.xml": "spreadsheetml.styles"}
    return _package("xl/workbook.xml", "spreadsheetml.sheet.main", members, types, title, pinned_at)


def document(title: str, sections: list[tuple[str, list[str], tuple[list, list] | None]], pinned_at: str) -> bytes:
    """DOCX: a title, then sections of a heading, paragraphs and perhaps a table (header, rows)."""

    def line(text, size=22, bold=False):
        return f'<w:p><w:r><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/></w:rPr><w:t xml:space="preserve">{_text(text)}</w:t></w:r></w:p>'

    def table(header, rows):
        row = lambda cells, bold: "<w:tr>" + "".join(f"<w:tc>{line('' if c is None else c, 20, bold)}</w:tc>" for c in cells) + "</w:tr>"
        return "<w:tbl><w:tblPr/><w:tblGrid>" + "<w:gridCol/>" * len(header) + "</w:tblGrid>" + row(header, True) + "".join(row(r, False) for r in rows) + "</w:tbl>"

    body = line(title, 40, True)
    for heading, paragraphs, cells in sections:
        body += line(heading, 28, True) + "".join(map(line, paragraphs)) + (table(*cells) + line("") if cells else "")
    members = {"word/document.xml": HEAD + f'<w:document xmlns:w="{WORD_NS}"><w:body>{body}<w:sectPr/></w:body></w:document>'}
    return _package("word/document.xml", "wordprocessingml.document.main", members, {}, title, pinned_at)


def slides(title: str, pages: list[tuple[str, list[str]]], pinned_at: str) -> bytes:
    """PPTX: a title slide, then pages of a heading and lines; long pages go on in further slides."""
    made = [(title, [])]
    for heading, lines in pages:
        made += [(heading, lines[at : at + SLIDE_LINES]) for at in range(0, max(len(lines), 1), SLIDE_LINES)]

    def shape(k, y, height, lines, size):
        text = "".join(f'<a:p><a:r><a:rPr lang="en" sz="{size}"/><a:t>{_text(x)}</a:t></a:r></a:p>' for x in lines) or "<a:p/>"
        return f'<p:sp><p:nvSpPr><p:cNvPr id="{k}" name="t{k}"/><p:cNvSpPr txBox="1"/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="457200" y="{y}"/><a:ext cx="8229600" cy="{height}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></p:spPr><p:txBody><a:bodyPr/>{text}</p:txBody></p:sp>'

    spaces = f'xmlns:p="{SLIDE_NS}" xmlns:a="{DRAW_NS}" xmlns:r="{OFFICE}"'
    tree = lambda inner: f'<p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{inner}</p:spTree></p:cSld>'
    members = {f"ppt/slides/slide{k}.xml": HEAD + f"<p:sld {spaces}>{tree(shape(2, 274638, 900000, [heading], 2800) + shape(3, 1300000, 5000000, lines, 1600))}</p:sld>" for k, (heading, lines) in enumerate(made, 1)}
    members |= {f"ppt/slides/_rels/slide{k}.xml.rels": _relations([("rId1", f"{OFFICE}/slideLayout", "../slideLayouts/slideLayout1.xml")]) for k in range(1, len(made) + 1)}
    colours = "".join(f'<a:{n}><a:srgbClr val="{v}"/></a:{n}>' for n, v in (("dk1", "000000"), ("lt1", "FFFFFF"), ("dk2", "222222"), ("lt2", "EEEEEE"), *((f"accent{k}", "336699") for k in range(1, 7)), ("hlink", "0000FF"), ("folHlink", "800080")))
    font = '<a:latin typeface="Arial"/><a:ea typeface=""/><a:cs typeface=""/>'
    fills = '<a:solidFill><a:schemeClr val="phClr"/></a:solidFill>' * 3
    lines_ = "<a:ln><a:solidFill><a:schemeClr val=\"phClr\"/></a:solidFill></a:ln>" * 3
    members["ppt/theme/theme1.xml"] = HEAD + f'<a:theme xmlns:a="{DRAW_NS}" name="t"><a:themeElements><a:clrScheme name="c">{colours}</a:clrScheme><a:fontScheme name="f"><a:majorFont>{font}</a:majorFont><a:minorFont>{font}</a:minorFont></a:fontScheme><a:fmtScheme name="m"><a:fillStyleLst>{fills}</a:fillStyleLst><a:lnStyleLst>{lines_}</a:lnStyleLst><a:effectStyleLst>{"<a:effectStyle><a:effectLst/></a:effectStyle>" * 3}</a:effectStyleLst><a:bgFillStyleLst>{fills}</a:bgFillStyleLst></a:fmtScheme></a:themeElements></a:theme>'
    names = " ".join(f'{n}="{v}"' for n, v in (("bg1", "lt1"), ("tx1", "dk1"), ("bg2", "lt2"), ("tx2", "dk2"), *((f"accent{k}", f"accent{k}") for k in range(1, 7)), ("hlink", "hlink"), ("folHlink", "folHlink")))
    members["ppt/slideMasters/slideMaster1.xml"] = HEAD + f'<p:sldMaster {spaces}>{tree("")}<p:clrMap {names}/><p:sldLayoutIdLst><p:sldLayoutId id="2147483649" r:id="rId1"/></p:sldLayoutIdLst></p:sldMaster>'
    members["ppt/slideMasters/_rels/slideMaster1.xml.rels"] = _relations([("rId1", f"{OFFICE}/slideLayout", "../slideLayouts/slideLayout1.xml"), ("rId2", f"{OFFICE}/theme", "../theme/theme1.xml")])
    members["ppt/slideLayouts/slideLayout1.xml"] = HEAD + f"<p:sldLayout {spaces}>{tree('')}</p:sldLayout>"
    members["ppt/slideLayouts/_rels/slideLayout1.xml.rels"] = _relations([("rId1", f"{OFFICE}/slideMaster", "../slideMasters/slideMaster1.xml")])
    listed = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k + 1}"/>' for k in range(1, len(made) + 1))
    members["ppt/presentation.xml"] = HEAD + f'<p:presentation {spaces}><p:sldMasterIdLst><p:sldMasterId id="2147483648" r:id="rId1"/></p:sldMasterIdLst><p:sldIdLst>{listed}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/><p:notesSz cx="6858000" cy="9144000"/></p:presentation>'
    members["ppt/_rels/presentation.xml.rels"] = _relations([("rId1", f"{OFFICE}/slideMaster", "slideMasters/slideMaster1.xml")] + [(f"rId{k + 1}", f"{OFFICE}/slide", f"slides/slide{k}.xml") for k in range(1, len(made) + 1)])
    types = {f"ppt/slides/slide{k}.xml": "presentationml.slide" for k in range(1, len(made) + 1)} | {"ppt/slideMasters/slideMaster1.xml": "presentationml.slideMaster", "ppt/slideLayouts/slideLayout1.xml": "presentationml.slideLayout", "ppt/theme/theme1.xml": "theme"}
    return _package("ppt/presentation.xml", "presentationml.presentation.main", members, types, title, pinned_at)
