"""Divergence of sources within a language, by an inverted index of baseline corrections (operator 11).

A language keeps the V terms that occur in at least LEAST_DOCS of its documents. Every source of the language, and the
language itself, gives each kept term the smoothed share p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)), in
exact integers. Two parts are reported: `pair`, the sum over all kept terms of |p - q| for each two sources of a
language, and `term`, the TOP terms that a source gives more than its language does.

No pair of sources looks at all V terms. A pair starts at V * |p0 - q0|, what it would have if neither source used any
kept term. Corrections then come in two kinds, only where they are not zero. A term of one source changes the pair by an
amount that depends on its count alone, so these are emitted once for each (source, count) with the number of its terms.
A term that both sources use is met in the term's postings, which corrects what the two one-sided corrections of it got
wrong. The work follows the postings and the pairs that are asked for.

Counting is one pass: each task counts (language, source, term) in a bounded table before the shuffle, so that a source
or a term that is everywhere arrives as one row a task. Shares are decimals of up to 38 digits, so that no count
overflows.

Edge cases: a null text, lang or source reads as ''; a source without terms, or a language without kept terms (V = 0),
has pairs of value 0 (all shares are equal or there are none) and no `term` rows; a language with one source has no
pairs; repeated rows are documents of their own; ties rank by the item's UTF-8 bytes; an empty table gives no rows; a
very long text is split a part at a time; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spool

LEAST_DOCS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP = 50
#: Entries of a task's table of counts; beyond it the counts so far are handed on.
MOST_COUNTS = 400_000
#: Bytes of a text that are split at once, about.
PART = 1 << 20
#: Bytes that end a term become blanks, A-Z become a-z; bytes of 0x80 and more belong to letters beyond ASCII.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts by task, occurrences and documents; terms are runs of ASCII letters and of characters beyond ASCII."""

    def count(batches):
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            lang, source, text = batch.columns
            for start in range(0, batch.num_rows, 256):
                for a, b, t in zip(*(c.slice(start, 256).to_pylist() for c in (lang, source, text)), strict=True):
                    total, found = seen.get((a, b)) or seen.setdefault((a, b), (Counter(), Counter()))
                    before, own = len(total), set()
                    for words in _words(t):
                        total.update(words)
                        own.update(words)
                    found.update(own)
                    size += len(total) - before
                    if size > MOST_COUNTS:
                        yield from _as_batches(seen)
                        seen, size = {}, 0
        yield from _as_batches(seen)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    got = docs.select(_named(F.col("lang")).alias("lang"), _named(F.col("source")).alias("source"), text.alias("text"))
    return got.mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def _words(text: bytes):
    """The terms of a text, a part at a time; parts end between terms."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + PART)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _named(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _as_batches(seen: dict):
    for (lang, source), (total, found) in seen.items():
        n = len(total)
        if n:
            docs = pa.array(map(found.__getitem__, total), pa.int64())
            columns = [pa.repeat(lang, n), pa.repeat(source, n), pa.array(total, pa.binary()), pa.array(total.values(), pa.int64()), docs]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)), exact for counts of up to 20 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + ADDED), wide(total) + F.lit(ADDED).cast("decimal(3,0)") * wide(kept)) + 1


def kept_counts(docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(postings, groups). postings: lang, source, term, n, n_lang of kept terms; groups: lang, source, total, total_lang, kept of every pair that occurs."""
    counts = spool(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs")
    postings = spool(counts.drop("docs").join(terms, ["lang", "term"]))
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = postings.groupBy("lang", "term").agg(F.first("n_lang").alias("n_lang")).groupBy("lang").agg(F.sum("n_lang").alias("total_lang"), F.count("*").alias("kept"))
    occurring = docs.select(_named(F.col("lang")).alias("lang"), _named(F.col("source")).alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = occurring.join(sums, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", zero("total"), zero("total_lang"), zero("kept"))
    return postings, spool(groups)


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the sum of |p - q| over all kept terms, for each two sources of a language, in both orders."""
    p0 = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept")))
    base = groups.select("lang", "source", "kept", F.coalesce(p0, F.lit(0)).alias("p0"))
    left = base.select("lang", "source", "kept", "p0")
    right = base.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").where(F.col("source") != F.col("item"))
    apart = F.abs(F.col("p0") - F.col("q0"))
    start = pairs.where(F.col("source") < F.col("item")).select("lang", "source", "item", (F.col("kept") * apart).alias("value"))

    shares = spool(postings.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p")))
    by_count = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    change = F.abs(F.col("p") - F.col("q0")) - apart
    ordered = [F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")]
    one_sided = by_count.join(pairs, ["lang", "source"]).select("lang", *ordered, (F.col("terms") * change).alias("value")).where("value <> 0")

    own = shares.join(base, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    other = own.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = F.abs(F.col("p") - F.col("q")) - F.abs(F.col("p") - F.col("q0")) - F.abs(F.col("p0") - F.col("q")) + apart
    two_sided = own.join(other, ["lang", "term"]).where(F.col("source") < F.col("item")).select("lang", "source", "item", both.alias("value")).where("value <> 0")

    summed = start.unionAll(one_sided).unionAll(two_sided).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def term_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: p - q of the terms that a source uses and gives more than its language."""
    p = _share(F.col("n"), F.col("total"), F.col("kept"))
    q = _share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    return postings.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").cast("string").alias("item"), (p - q).alias("value")).where("value > 0")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of both parts; ranks go by value descending, then the item's bytes."""
    postings, groups = kept_counts(docs, least)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank)
    pairs = columns(pair_values(postings, groups), "pair")
    return pairs.unionAll(columns(term_values(postings, groups), "term").where(F.col("rank") <= top))
