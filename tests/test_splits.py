"""Splittable CSV scan: records and row numbers equal Python's csv module, whatever the splits."""

from __future__ import annotations

import csv
import io
import random

import pytest

from tidemark.sources import audit, exports, splits


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def expected(text: str, separator: str, width: int) -> list[tuple]:
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r]
    return [(k, len(r), *(r[c] if c < len(r) else None for c in range(width))) for k, r in enumerate(rows, 1)][1:]


def made(seed: int, rows: int, separator: str, line_break: str) -> str:
    rnd, out = random.Random(seed), [f"keyword{separator}volume{separator}difficulty"]
    cells = ["a", "b c", "", '"x"', '"a\nb"', f'"p{separator}q"', '"say ""hi"""', 'in"ch', '"t"ail', '"\n\n"', "é ü", '"l\r\nm"', "  "]
    for _ in range(rows):
        out.append(separator.join(rnd.choice(cells) for _ in range(rnd.choice((3, 3, 3, 2, 4)))))
        if rnd.random() < 0.1:
            out.append("")
    return line_break.join(out) + (line_break if rnd.random() < 0.5 else "")


@pytest.mark.parametrize(("seed", "separator", "line_break", "size"), [(1, ",", "\n", 64), (2, ";", "\r\n", 37), (3, "\t", "\n", 500), (4, ",", "\r\n", 1 << 20), (5, "|", "\n", 11)])
def test_any_splits_read_the_same_records(spark, tmp_path, small_splits, seed, separator, line_break, size):
    text = made(seed, 300 if size > 30 else 60, separator, line_break)
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    small_splits(size)
    got, total = splits.read_cells(spark, str(path), separator, "utf-8", 3)
    rows = sorted((r.source_row, r.n_cells, r.c0, r.c1, r.c2) for r in got.collect())
    want = expected(text, separator, 3)
    assert rows == want and total == len(want) + 1
    if size < 100:
        assert got.select("block").distinct().count() > 5


def test_unclosed_quotes_blank_files_and_lone_returns(spark, tmp_path, small_splits):
    small_splits(16)
    path = tmp_path / "x.csv"
    path.write_text('keyword,volume\na,1\n"b,2\nc,3\nd,4')
    got, total = splits.read_cells(spark, str(path), ",", "utf-8", 2)
    assert [(r.source_row, r.c0) for r in got.orderBy("source_row").collect()] == [(2, "a"), (3, "b,2\nc,3\nd,4\n")] and total == 3
    path.write_text("keyword,volume\n\n\n")
    with pytest.raises(exports.SourceError):
        exports.raw_rows(spark, exports.sniff(path))
    path.write_bytes("kéyword,volume\rà,1\rb,2".encode("iso-8859-1"))
    s = exports.sniff(path)
    assert (s.encoding, s.line_break) == ("iso-8859-1", "\r")
    assert [r.c0 for r in exports.raw_rows(spark, s).orderBy("source_row").collect()] == ["à", "b"]
    path.write_bytes("keyword,volume\na,1\nb,2\n".encode("utf-16"))
    assert [r.c0 for r in exports.raw_rows(spark, exports.sniff(path)).orderBy("source_row").collect()] == ["a", "b"]


def test_a_corpus_is_numbered_alike_by_any_splits(spark, tmp_path, small_splits):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("keyword,volume\n" + "".join(f'"kw {k} {i}\n x",{i}\n' if i % 7 else f"{'x' * 201},{i}\n" for i in range(200)))
    columns = ["kw_idx", "keyword", "source_row", "source_file"]
    whole = exports.read_exports(spark, [tmp_path]).select(columns).orderBy("kw_idx").collect()
    small_splits(128)
    split = exports.read_exports(spark, [tmp_path]).select(columns).orderBy("kw_idx").collect()
    assert whole == split and [r.kw_idx for r in split] == list(range(342)) and split[0].source_row == 3 and split[171].keyword == "kw 1 1 x"


def test_the_audit_counts_cells_by_the_scan(spark, tmp_path, small_splits):
    small_splits(32)
    path = tmp_path / "x.csv"
    path.write_text('keyword,volume\n"a\nb",1\nc\n"d,\n",2,3\ne,5\n')
    assert [tuple(r) for r in audit.ragged(spark, path).orderBy("row").collect()] == [(3, 1, 2), (4, 3, 2)]
    assert {f[1] for f in audit.file_checks(path, most_bytes=10)} == {"oversized_file"}
