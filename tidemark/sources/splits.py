"""CSV files of any size, read by many tasks with exact records and row numbers.

Quoted cells may hold line breaks, so that the start of a split may lie inside a record and nobody can tell from there.
Two passes settle it. The first walks the lines of each split twice at once, as if it began outside and inside a quoted
cell, and keeps two counts and two end states; chaining these from the file's start gives each split's true state and the
number of its first record (one row for each split, on the driver). The second parses each split from there. Records that
cross splits leave their lines as fragments under the record's number, which are put together by a group.

Lines come from Spark's text source, so that a file may lie in any store. Cells follow Python's csv module: a quote opens a
cell only at its start, a doubled one stands for itself, text after a closing quote belongs to the cell. Empty lines
between records are no records. A quote that is never closed makes one record of the rest of the file.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cells may be of any length.
CELL_CHARS = (1 << 31) - 1
BLANK = (b"", b"\r")


def closer(separator: bytes) -> Callable[[bytes, bool], bool]:
    """A function (line, begins inside a quoted cell) -> ends inside one."""
    opening = re.compile(rb'(?:\A|' + re.escape(separator) + rb')"')
    later = re.compile(re.escape(separator) + rb'"')

    def ends_inside(line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at = 0
        if not inside:
            found = opening.match(line) or later.search(line)
            if found is None:
                return False
            at = found.end()
        while True:
            quote = line.find(b'"', at)
            if quote < 0:
                return True
            if line[quote + 1 : quote + 2] == b'"':
                at = quote + 2
                continue
            found = later.search(line, quote + 1)
            if found is None:
                return False
            at = found.end()

    return ends_inside


def _lines(spark: SparkSession, path: str, line_break: str) -> DataFrame:
    return spark.read.option("lineSep", line_break).text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """(block, lines) of the consecutive rows of each block."""
    lines, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start = 0
    while start < len(blocks):
        end = len(blocks) if blocks[-1] == blocks[start] else next(k for k in range(start, len(blocks)) if blocks[k] != blocks[start])
        yield blocks[start], lines[start:end]
        start = end


def survey(spark: SparkSession, path: str, separator: str, line_break: str = "\n") -> dict[int, tuple[bool, int, bool, int]]:
    """By split: (begins inside a quoted cell, records that end before it, ends inside one, records that end in it)."""
    sep = separator.encode()

    def walk(batches):
        ends_inside, seen = closer(sep), {}
        for batch in batches:
            for block, lines in _runs(batch):
                state = seen.setdefault(block, [[False, 0], [True, 0]])
                for own in state:
                    inside, n = own
                    for line in lines:
                        was, inside = inside, ends_inside(line, inside)
                        n += not inside and (was or line not in BLANK)
                    own[:] = inside, n
        columns = [pa.array(seen, pa.int64())] + [pa.array([s[h][k] for s in seen.values()], t) for h in (0, 1) for k, t in ((0, pa.bool_()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "outside_end", "outside_n", "inside_end", "inside_n"])

    found = _lines(spark, path, line_break).mapInArrow(walk, "block long, outside_end boolean, outside_n long, inside_end boolean, inside_n long").collect()  # one row for each split
    out, inside, records = {}, False, 0
    for r in sorted(found):
        end, n = (r.inside_end, r.inside_n) if inside else (r.outside_end, r.outside_n)
        out[r.block] = (inside, records, end, n)
        inside, records = end, records + n
    return out


def read_cells(spark: SparkSession, path: str, separator: str, encoding: str, width: int, line_break: str = "\n") -> tuple[DataFrame, int]:
    """(source_row, block, n_cells, c0 ... of each record but the header, which is row 1; number of records). Cells beyond the width go, missing ones are null."""
    splits = survey(spark, path, separator, line_break)
    total = sum(s[3] for s in splits.values()) + (splits[max(splits)][2] if splits else False)  # an unclosed last record counts
    sep, joint = separator.encode(), line_break.encode()
    fields = ", ".join(["source_row long", "block long", "n_cells int", *(f"c{k} string" for k in range(width))])
    names = ["source_row", "block", "n_cells", *(f"c{k}" for k in range(width))]

    def cells(lines: list[bytes]) -> list[list[str]]:
        csv.field_size_limit(CELL_CHARS)
        text = (x.decode(encoding, "replace") + "\n" for x in lines)
        return [row for row in csv.reader(text, delimiter=separator) if row]

    def table(numbers: list[int], blocks: list[int], rows: list[list[str]]) -> pa.RecordBatch:
        columns = [pa.array(numbers, pa.int64()), pa.array(blocks, pa.int64()), pa.array([len(r) for r in rows], pa.int32())]
        columns += [pa.array([r[k] if k < len(r) else None for r in rows], pa.string()) for k in range(width)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def walk(batches, whole: bool) -> Iterator[tuple]:
        """Either (block, number of the first, lines) of records within a split, or (block, number, lines) of parts of records that cross."""
        ends_inside, state = closer(sep), {}
        for batch in batches:
            for block, lines in _runs(batch):
                if block not in splits:
                    raise ValueError("the splits have changed since the file was surveyed; keep spark.sql.files.maxPartitionBytes as it was")
                inside, number, head, part = state.get(block) or (splits[block][0], splits[block][1], splits[block][0], [])
                ready, first = [], number
                for line in lines:
                    was, inside = inside, ends_inside(line, inside)
                    part.append(line)
                    if inside:
                        continue
                    if head:
                        if not whole:
                            yield block, number, part
                        number, first, head = number + 1, number + 1, False
                    elif was or line not in BLANK:
                        ready += part
                        number += 1
                    part = []
                state[block] = inside, number, head, part
                if whole and ready:
                    yield block, first, ready
        if not whole:
            for block, (_, number, _, part) in state.items():
                if part:
                    yield block, number, part

    def parse(batches):
        for block, first, lines in walk(batches, True):
            rows = cells(lines)
            numbers = list(range(first + 1, first + 1 + len(rows)))
            if first == 0:  # the header
                numbers, rows = numbers[1:], rows[1:]
            yield table(numbers, [block] * len(rows), rows)

    def fragments(batches):
        for block, number, lines in walk(batches, False):
            ends = [joint.join(lines)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block], pa.int64()), pa.array(ends, pa.binary())], names=["number", "block", "part"])

    def crossing(batches):
        for batch in batches:
            for number, block, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = cells(joint.join(parts).split(joint))
                if number and rows:
                    yield table([number + 1], [block], rows[:1])

    lines = _lines(spark, path, line_break)
    out = lines.mapInArrow(parse, fields)
    crossed = [b for b, s in splits.items() if s[0] or s[2]]
    if crossed:
        kept = lines.where(F.col("block").isin(crossed)) if len(crossed) < 1000 else lines
        parts = kept.mapInArrow(fragments, "number long, block long, part binary")
        joined = parts.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("block", "part"))).alias("x"))  # of one record
        out = out.unionAll(joined.select("number", F.element_at("x", -1)["block"].alias("block"), F.col("x.part").alias("parts")).mapInArrow(crossing, fields))
    return out, total
