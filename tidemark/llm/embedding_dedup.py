"""Embedding near-dedup (operator 2).

Vectors get pseudo-random rotations (three rounds of random signs and a fast Hadamard transform) and are hashed to the
nearest vertex of the cross-polytope. A table's key joins several such vertices; besides its own bucket, a vector is put
into those where one of its vertices is the second nearest (multiprobe). The keys get as many vertices as keep buckets of
unrelated vectors small (the number of vectors decides), and there are as many tables as make the probability that a pair
at the threshold shares no bucket MISS at most (see plan).

Only ids and sign sketches of 16 bytes travel to the buckets. Rows whose sketch is near no other of the bucket are
dropped there; vectors are fetched for the rest. Cosines are then computed in double precision; a pair counts in the
smallest bucket that it shares, so that links are counted and not emitted. Large buckets are cut into blocks. Equal
vectors are one class throughout.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length never link; very large and very small components are scaled before squaring; null ids are rows of their
own, whose component is the smallest id reachable (null if none); repeated rows are copies of each other; extra columns
are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool
from .graph import by_group, components, fixed

#: Probability that a pair at the threshold shares no bucket, and that its sketches are ruled out, at most.
MISS, SKETCH_MISS = 1e-5, 1e-6
#: Possible keys of a table for each vector, at least.
ROOM = 8
SKETCH_BITS = 128
#: Rows of a bucket that meet in one task are two blocks of about so many at most.
BLOCK = 4096
SEED = 20_240_229


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _wide(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def codes(unit: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables, 1 + hashes) 64-bit keys: each table's own, then its probes. Keys of different tables or lengths differ."""
    n, d = unit.shape
    wide = _wide(d)
    x = np.zeros((n, wide))
    x[:, :d] = unit
    signs, row, out = np.random.default_rng(SEED), np.arange(n), np.zeros((n, tables, 1 + hashes), np.uint64)
    for t in range(tables):
        near = []
        for _ in range(hashes):
            y = x
            for _ in range(3):
                y = _hadamard(y * signs.choice((-1.0, 1.0), wide))
            size = np.abs(y)
            first = size.argmax(1)
            size[row, first] = -1
            near.append([(2 * v + (y[row, v] > 0)).astype(np.uint64) for v in (first, size.argmax(1))])
        for probe in range(1 + hashes):
            key = np.full(n, (t << 32) + d, np.uint64)
            for k in range(hashes):
                key = (key ^ near[k][probe == k + 1]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            out[:, t, probe] = key >> np.uint64(1)
    return out.view(np.int64)


def pairs_at(cosine: float, n: int, d: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with that cosine."""
    a, b = np.random.default_rng(seed).normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    if d > 1:
        b -= (a * b).sum(1)[:, None] * a
        b /= np.linalg.norm(b, axis=1)[:, None]
        b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    return a, (b if d > 1 else a)


@lru_cache(maxsize=64)
def plan(d: int, n: int, least: float) -> tuple[int, int]:
    """(tables, hashes) for n vectors of length d: the share of tables in which pairs at the threshold meet is measured."""
    hashes = max(2, math.ceil(math.log(ROOM * max(n, 1)) / math.log(2 * _wide(d))))
    a, b = (codes(x, 8, hashes) for x in pairs_at(least, 256, d))
    meet = (a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean()
    meet -= 2 * math.sqrt(max(meet * (1 - meet), 1e-3) / (8 * 256))  # the estimate's own error
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(max(meet, 0.01), 0.999)))), hashes


@lru_cache(maxsize=8)
def _planes(d: int) -> np.ndarray:
    return np.random.default_rng(SEED + d).normal(size=(d, SKETCH_BITS))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Signs of random projections, packed."""
    return np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1)


def most_bits(least: float) -> int:
    """Largest Hamming distance of sketches that isn't ruled out: a pair at the threshold exceeds it with probability SKETCH_MISS at most."""
    p, tail, k = math.acos(min(1.0, least)) / math.pi, 1.0, -1
    while tail > SKETCH_MISS and k < SKETCH_BITS:
        k += 1
        tail -= math.comb(SKETCH_BITS, k) * p**k * (1 - p) ** (SKETCH_BITS - k)
    return k


def _clean(values, kind: str) -> np.ndarray | None:
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, kind)
    return x if np.isfinite(x).all() and x.any() else None


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component is brought to 1 first, so that no square vanishes or overflows."""
    x = vectors.astype(float)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _dealt(placed: DataFrame) -> DataFrame:
    """Rows (key, d, cid) of buckets of two rows or more, with their block (own), for each pair of blocks (i, j) they belong to."""
    sizes = spool(placed.groupBy("key", "d").agg(F.count("*").alias("size")).where("size > 1"))
    cut = placed.join(sizes, ["key", "d"]).withColumn("n", F.ceil(F.col("size") / BLOCK)).withColumn("own", F.expr("pmod(xxhash64(cid), n)")).drop("size")
    cut = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")).drop("n")
    return cut.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two blocks that meet (the same rows twice for a block and itself). Columns: key, d, i, j, own."""
    i, j = t.column(2)[0].as_py(), t.column(3)[0].as_py()
    own = t.column(4).to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j)


def near_vectors(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    bits = most_bits(least)

    def classify(batches):
        for batch in batches:
            found = [_clean(x, kind) for x in batch.column(1).to_pylist()]
            raw = [None if x is None else (x + x.dtype.type(0)).tobytes() for x in found]  # without negative zeros
            cls = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "cls", "vec"])

    read = vectors.select("vec_id", "embedding").mapInArrow(classify, f"vec_id {id_type}, cls binary, vec binary")
    classes = spool(read.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec")).withColumn("cid", F.monotonically_increasing_id()))
    lengths = {r.d: r.n for r in classes.groupBy((F.length("vec") / int(kind[1])).cast("int").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row for each vector length

    def shape(d: int) -> tuple[int, int]:
        tables, hashes = plan(d, lengths[d], least)
        return tables, 1 + hashes

    def by_length(batches):
        """Rows of equal length d, with their unit vectors; the vector is the batch's second column."""
        for batch in batches:
            size = np.array([len(x) // int(kind[1]) for x in batch.column(1).to_pylist()], np.int64)
            for d in map(int, np.unique(size)):
                rows = np.flatnonzero(size == d)
                for at in range(0, len(rows), 1024):
                    part = batch.take(pa.array(rows[at : at + 1024]))
                    yield d, part, units(fixed(part.column(1), kind))

    def bucket(batches):
        for d, part, unit in by_length(batches):
            own = codes(unit, *plan(d, lengths[d], least)).reshape(len(unit), -1)
            again = pa.array(np.repeat(np.arange(len(own)), own.shape[1]))
            sketch = pa.array([r.tobytes() for r in sketches(unit)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.full(own.size, d)), part.column(0).take(again), sketch.take(again)], names=["key", "d", "cid", "sketch"])

    keyed = spool(classes.select("cid", "vec").mapInArrow(bucket, "key long, d long, cid long, sketch binary"))

    def plausible(t: pa.Table):
        left, right = _sides(t)
        cid, s = t.column(5).to_numpy(), fixed(t.column(6), "u8")
        some = np.zeros(len(cid), bool)
        for at in range(0, len(left), 128):
            part = left[at : at + 128]
            near = np.bitwise_count(s[part][:, None] ^ s[right]).sum(2, dtype=np.int16) <= bits
            near &= part[:, None] != right
            some[part[near.any(1)]] = True
            some[right[near.any(0)]] = True
        if some.any():
            n = int(some.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t.column(k)[0].as_py())) for k in (0, 1)] + [pa.array(cid[some])], names=["key", "d", "cid"])

    groups = ["key", "d", "i", "j"]
    live = spool(by_group(_dealt(keyed).select(*groups, "own", "cid", "sketch"), groups, plausible, "key long, d long, cid long").distinct())

    def with_keys(batches):
        for d, part, unit in by_length(batches):
            keys = codes(unit, *plan(d, lengths[d], least)).reshape(len(unit), -1)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in keys], pa.binary())], names=["cid", "vec", "copies", "keys"])

    def compare(t: pa.Table):
        left, right = _sides(t)
        here, d = t.column(0)[0].as_py(), t.column(1)[0].as_py()
        cid, copies, x = t.column(5).to_numpy(), t.column(6).to_numpy(), units(fixed(t.column(7), kind))
        key = fixed(t.column(8), "i8").reshape(len(x), *shape(d))
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        within = t.column(2)[0].as_py() == t.column(3)[0].as_py()
        found = []
        for at in range(0, len(left), 128):
            a, b = np.nonzero(x[left[at : at + 128]] @ x[right].T >= least)
            a, b = left[at : at + 128][a], right[b]
            if within:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), 8192):
                p, q = a[k : k + 8192], b[k : k + 8192]
                shared = np.where(key[p][:, :, :, None] == key[q][:, :, None, :], key[q][:, :, None, :], np.iinfo(np.int64).max).min((1, 2, 3))
                p, q = p[shared == here], q[shared == here]
                links += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
                found.append((p, q))
        if not links.any():
            return
        while True:
            before = root.copy()
            for p, q in found:
                np.minimum.at(root, p, root[q])
                np.minimum.at(root, q, root[p])
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root[some]]), pa.array(links[some])], names=["a", "b", "links"])

    wanted = classes.select("cid", "vec", "copies").join(live.select("cid").distinct(), "cid", "left_semi")
    wanted = spool(wanted.mapInArrow(with_keys, "cid long, vec binary, copies long, keys binary"))
    met = _dealt(live).join(wanted, "cid").select(*groups, "own", "cid", "copies", "vec", "keys")
    found = spool(by_group(met, groups, compare, "a long, b long, links long"))
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "cid")
    roots = components(found.select("a", "b")).withColumnRenamed("node", "cid")
    known = classes.select("cid", "cls", "first_id", "copies").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = spool(known)
    lowest = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = spool(known.join(lowest, "root").select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = read.where("cls is not null").select("vec_id", "cls").join(table, "cls").select("vec_id", "n_links", "component_id")
    alone = read.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.expr("vec_id <=> component_id"))
