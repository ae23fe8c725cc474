"""MinHash near-dedup with odd sketches (operator 7).

A document's set is its distinct word shingles (64-bit hashes). Equal sets are one class. Each class has SAMPLES
MinHash values: bands of them are bucket keys, and all of them are folded into an odd sketch, a bitmap in which each
value flips one bit, so that the population count of two sketches' XOR estimates a high similarity precisely.

In each bucket, every class is first compared with the bucket's smallest class (a star, linear in the bucket). What is
then still in several components is compared across components in blocks of bounded size by finer sketches, made for these
classes only. Pairs that the sketches don't rule out are confirmed on full sets. A pair at a threshold of 0.85 shares no band with a probability of
about (1 - 0.85^6)^24 = 1e-5; above it the probability vanishes. Lower thresholds get as many bands as keep it there (38 at 0.80).

Edge cases: a null text, or one without words, has the empty set and links with nothing; fewer words than a shingle
are one shingle; null ids are rows of their own, whose component is the smallest id reachable (null if none); repeated
rows are copies of each other; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, spool
from .graph import by_group, components, fixed

BANDS, ROWS = 24, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Pairs whose sketches estimate less than this below the threshold are ruled out (over four standard errors).
SLACK = 0.17
#: The same of the sketch that is made for classes in buckets of several components.
FINE_SAMPLES, FINE_BITS, FINE_SLACK = 1024, 4096, 0.05
BLOCK = 512


def _multipliers(n: int, seed: int) -> np.ndarray:
    out = np.random.default_rng(seed).integers(0, 1 << 32, (2, n), dtype=np.uint32)
    out[0] |= 1
    return out


def bands_at(percent: int) -> int:
    """Bands that miss a pair at percent/100 as rarely as BANDS bands do at 0.85."""
    if percent >= 85:
        return BANDS
    return math.ceil(BANDS * math.log1p(-(0.85**ROWS)) / math.log1p(-((percent / 100) ** ROWS)))


@lru_cache(maxsize=4)
def _banded(bands: int) -> np.ndarray:
    return _multipliers(bands * ROWS, 5)


_BANDED, _FINE = _multipliers(SAMPLES, 5), _multipliers(FINE_SAMPLES, 6)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):  # an ordered mix of the words' hashes
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(found: np.ndarray, hashes: np.ndarray = _BANDED) -> np.ndarray:
    x = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    out = np.full(hashes.shape[1], 0xFFFFFFFF, np.uint32)
    step = (1 << 16) // hashes.shape[1]  # stays in a core's cache
    for at in range(0, len(x), step):
        out = np.minimum(out, (x[at : at + step, None] * hashes[0] + hashes[1]).min(0))
    return out


def sketch(low: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Odd sketch of the samples (position, value): each flips one bit. bits is a power of two."""
    mixed = (low.astype(np.uint64) + np.arange(len(low), dtype=np.uint64) * np.uint64(1 << 32)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    hit = np.bincount((mixed >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits((hit & 1).astype(np.uint8)).tobytes()


def fine_sketch(found: np.ndarray) -> bytes:
    return sketch(minima(found, _FINE), FINE_BITS)


def most_bits(least: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, slack: float = SLACK) -> int:
    """Largest XOR population count of a pair that isn't ruled out."""
    return int(bits / 2 * (1 - np.exp(-4 * samples * (1 - least + slack) / bits)))


def fingerprints(docs: DataFrame, width: int, n_bands: int = BANDS) -> DataFrame:
    """doc_id, cls (digest of the set, null if empty), n_shingles, bands, sketch."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "cls", "n_shingles", "bands", "sketch"]

    def run(batches):
        for batch in batches:
            out, seen = [], {}
            for doc_id, text in rows(batch):
                found = shingles(text, width)
                if not len(found):
                    out.append((doc_id, None, 0, None, None))
                    continue
                cls = xxhash.xxh3_128_digest(found.tobytes())
                if cls not in seen:
                    low = minima(found, _banded(n_bands))
                    keys = [xxhash.xxh3_64_intdigest(part.tobytes(), seed=k) >> 1 for k, part in enumerate(low.reshape(n_bands, ROWS))]
                    if len(seen) < 10_000:
                        seen[cls] = keys, sketch(low[:SAMPLES])
                    else:
                        out.append((doc_id, cls, len(found), keys, sketch(low[:SAMPLES])))
                        continue
                out.append((doc_id, cls, len(found), *seen[cls]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [batch.schema.field(0).type, pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, cls binary, n_shingles long, bands array<long>, sketch binary")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int, bits: int) -> DataFrame:
    """Pairs (a, b) of classes that sizes and sketches don't rule out."""
    c = classes.select("cls", "n_shingles", *(F.expr(f"cast(conv(hex(substring(sketch, {1 + 8 * k}, 8)), 16, -10) as bigint)").alias(f"s{k}") for k in range(SKETCH_BITS // 64)))
    a = c.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), *(F.col(f"s{k}").alias(f"x{k}") for k in range(SKETCH_BITS // 64)))
    b = c.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), *(F.col(f"s{k}").alias(f"y{k}") for k in range(SKETCH_BITS // 64)))
    apart = " + ".join(f"bit_count(x{k} ^ y{k})" for k in range(SKETCH_BITS // 64))
    near = f"100 * least(na, nb) >= {percent} * greatest(na, nb) and {apart} <= {bits}"
    return pairs.join(a, "a").join(b, "b").where(near).select("a", "b")


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, width: int, fine: bool = False) -> DataFrame:
    """cls, set (and a fine sketch) of the wanted classes, from one text of each."""

    def run(batches):
        for batch in batches:
            found = [shingles(text, width) for (text,) in rows(batch)]
            cls = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
            columns = [pa.array(cls, pa.binary()), pa.array([x.view(np.int64).tolist() for x in found], pa.list_(pa.int64()))]
            if fine:
                columns.append(pa.array([fine_sketch(x) if len(x) else None for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "set", "fine"][: len(columns)])

    ids = spool(classes.join(wanted, "cls", "left_semi").select(F.col("first_id").alias("doc_id")).distinct())
    texts = docs.join(ids.where("doc_id is not null"), "doc_id", "left_semi").select("text").unionByName(docs.where("doc_id is null").select("text"))
    sets = texts.mapInArrow(run, "cls binary, set array<long>" + ", fine binary" * fine).join(wanted, "cls", "left_semi")
    return spool(sets.dropDuplicates(["cls"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def _mixed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, cls, root, size, main, n: the rows of buckets that hold several components, with the largest one and its rows."""
    labelled = keyed.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    mixed = labelled.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("size > 2 and lo <> hi").select("key", "size")
    within = spool(labelled.join(mixed, "key"))
    largest = within.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("n"))
    return spool(within.join(largest, "key"))


def _across(within: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within buckets, of different components, that sizes and fine sketches don't rule out.

    A bucket's rows outside its largest component are compared with all its rows, in blocks; a pair counts in the
    smallest bucket that it shares.
    """
    bits = most_bits(percent / 100, FINE_SAMPLES, FINE_BITS, FINE_SLACK)
    known = spool(classes.select("cls", "n_shingles", "bands").join(sets.select("cls", "fine"), "cls"))
    placed = within.join(known, "cls").select(
        "key", "cls", "root", "n_shingles", "fine", "bands", (F.col("root") != F.col("main")).alias("minor"), F.expr("abs(xxhash64(cls) % 1000003)").alias("h"),
        F.ceil((F.col("size") - F.col("n")) / BLOCK).alias("minors"), F.ceil(F.col("size") / BLOCK).alias("blocks"),
    )
    every = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)).alias("i"), (F.col("h") % F.col("blocks")).alias("j"), F.lit(False).alias("left"))
    minor = placed.where("minor").select("*", (F.col("h") % F.col("minors")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("left"))
    dealt = every.unionByName(minor).select("key", "i", "j", "left", "cls", "root", "n_shingles", "fine", "bands")

    def compare(t: pa.Table):
        key, left = t.column(0)[0].as_py(), t.column(3).to_numpy(zero_copy_only=False)
        cls, root = (np.array(t.column(k).to_pylist(), object) for k in (4, 5))
        _, label = np.unique(root, return_inverse=True)
        n, s = t.column(6).to_numpy(), fixed(t.column(7), "u8")
        bands = np.array(t.column(8).to_pylist(), np.int64)
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        out: list[tuple] = []
        for at in range(0, len(a), 32):
            part = a[at : at + 32]
            small, big = np.minimum(n[part][:, None], n[b]), np.maximum(n[part][:, None], n[b])
            x, y = np.nonzero((label[part][:, None] != label[b]) & (100 * small >= percent * big))
            x, y = part[x], b[y]
            for k in range(0, len(x), 4096):
                p, q = x[k : k + 4096], y[k : k + 4096]
                near = np.bitwise_count(s[p] ^ s[q]).sum(1, dtype=np.int64) <= bits
                p, q = p[near], q[near]
                shared = np.where(bands[p] == bands[q], bands[p], np.iinfo(np.int64).max).min(1)
                out += {(min(c, d), max(c, d)) for c, d in zip(cls[p[shared == key]], cls[q[shared == key]], strict=True)}
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([q for _, q in out], pa.binary())], names=["a", "b"])

    return by_group(dealt, ["key", "i", "j"], compare, "a binary, b binary").distinct()


def near_documents(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; links need percent/100 of similarity at least."""
    docs = docs.select("doc_id", "text")
    bits = most_bits(percent / 100)
    prints = spool(fingerprints(docs, width, bands_at(percent)))
    members = prints.select("doc_id", "cls", "n_shingles")
    classes = spool(prints.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first_id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch")))
    keyed = classes.select(F.explode("bands").alias("key"), "cls")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("cls").alias("a")).where("size > 1").select("key", "a")
    keyed = spool(keyed.join(spool(sizes), "key"))
    stars = keyed.where("cls <> a").select("a", F.col("cls").alias("b")).distinct()
    likely = spool(_plausible(stars, classes, percent, bits))
    linked = spool(_confirmed(likely, _sets(_ends(likely), docs, classes, width), percent))
    roots = spool(components(linked))
    within = _mixed(keyed.select("key", "cls"), roots)
    sets = _sets(within.select("cls").distinct(), docs, classes, width, fine=True)
    more = _confirmed(spool(_across(within, sets, classes, percent)), sets, percent)
    roots = components(linked.unionByName(more))
    known = spool(classes.select("cls", "first_id", "n_shingles").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    table = spool(known.join(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("cls", "component_id"))
    full = members.where("cls is not null").join(table, "cls").select("doc_id", "n_shingles", "component_id")
    empty = members.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).withColumn("kept", F.expr("doc_id <=> component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs (integer doc_id, text, any other columns) with one row of each group of near copies: that with the smallest id.

    Rows are told apart even where they repeat an id or have none: of rows with one id any may stay, a row without an id
    stays only where its group has none with an id. Rows without words are no copies and all stay.
    """
    same = [F.col(f"`{c}`") for c in docs.columns]
    repeated = spool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    plain = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").select(*same)
    odd = docs.where("doc_id is not null").join(repeated, "doc_id", "left_semi").select(*same).unionByName(docs.where("doc_id is null"))
    odd = spool(odd.select(F.struct(*same).alias("row"), F.monotonically_increasing_id().alias("n")))  # written once, so that the numbers hold
    key = lambda c: F.lpad((F.col(c).cast("decimal(20,0)") + F.expr("9223372036854775808BD")).cast("string"), 20, "0")  # noqa: E731  # sorts as the id does
    number = F.concat(F.coalesce(key("row.doc_id"), F.lit("none")), F.lit("."), F.lpad(F.col("n").cast("string"), 19, "0"))
    numbered = odd.select(number.alias("doc_id"), F.col("row.text").alias("text"), "row")
    gone = spool(near_documents(plain.select(key("doc_id").alias("doc_id"), "text").unionByName(numbered.select("doc_id", "text")), width, percent).where("not kept").select("doc_id"))
    known = F.expr("cast(substring(doc_id, 1, 20) as decimal(20,0)) - 9223372036854775808BD").cast(docs.schema["doc_id"].dataType)
    plain_gone = spool(gone.where("length(doc_id) = 20").select(known.alias("doc_id")))  # ids as they were: fewer bytes, and fewer than those that stay
    return plain.join(plain_gone, "doc_id", "left_anti").select(*same).unionByName(numbered.join(gone, "doc_id", "left_anti").select("row.*"))
