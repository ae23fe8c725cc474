"""Clusters of embeddings: a graph of nearest neighbours by a forest of random half-spaces, then label propagation.

Each of TREES trees cuts the space by random half-spaces, one bit a cut. A vector's leaf is the shortest prefix of its bits
that no more than LEAF vectors share, so that dense regions are cut finer and no leaf grows with the table; a vector also
visits, in every tree, the leaf beyond its most uncertain cut. Within a leaf all cosines are exact, and a vector keeps the
best `k` of all its leaves. Equal vectors are one node. What still shares all BITS cuts is so alike that leaves are dealt
by hash there: any neighbour is as good.

The search is approximate; tests hold its recall against brute force. Labels then spread along the graph: every node takes
the label with the largest sum of similarities around it, its own included, the smallest of equals, until none changes or
after a stated number of rounds. Nothing goes to the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import settle

TREES, BITS, LEAF, STEP = 10, 48, 512, 4


def nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, members): node, vector (unit length, as bytes), near and far bits by tree; id, node. df: id, vector.

    Vectors that are null, empty or zero, or hold null or non-finite components, are no nodes. A node's name is the
    smallest id of its equal vectors; vectors of different lengths are never neighbours.
    """
    fit = F.filter("vector", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    good = df.where((F.size("vector") > 0) & (F.size(fit) == F.size("vector")) & F.exists("vector", lambda x: x != 0))
    keyed = good.select("id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    members = settle(keyed.select("id", F.xxhash64("vector").alias("h"), F.sha2(F.to_json(F.struct("vector")), 256).alias("same"), "vector"))
    first = members.groupBy("same").agg(F.min("id").alias("node"), F.any_value("vector").alias("vector"))
    kind = df.schema["id"].dataType.simpleString()

    def cut(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1).to_pylist()
            out, near, far = [], [], []
            for row in rows:
                v = np.array(row)
                v = v / np.abs(v).max()  # neither overflows nor vanishes
                v /= np.sqrt((v * v).sum())
                n = len(v)
                if n not in planes:
                    planes[n] = np.random.default_rng(n).normal(size=(TREES * BITS, n))
                side = (planes[n] @ v).reshape(TREES, BITS)
                bits = side > 0
                other = bits.copy()
                unsure = np.abs(side[:, :12]).argmin(1)  # among the first cuts, which decide most
                other[np.arange(TREES), unsure] ^= True
                text = lambda b: ["".join("01"[x] for x in t) for t in b.astype(int).tolist()]
                out.append(v.tobytes())
                near.append(text(bits))
                far.append(text(other))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array(near, pa.list_(pa.string())), pa.array(far, pa.list_(pa.string()))], names=["node", "vector", "near", "far"])

    vectors = first.select("node", "vector").mapInArrow(cut, f"node {kind}, vector binary, near array<string>, far array<string>")
    return settle(vectors), members.join(first.select("same", "node"), "same").select("id", "node")


def leaves(vectors: DataFrame) -> DataFrame:
    """(node, leaf, home): the leaves that a node visits; home tells its own from those beyond its most uncertain cut."""
    size = F.octet_length("vector")
    trees = F.transform("near", lambda b, t: F.struct(t.alias("tree"), b.alias("near"), F.element_at("far", t + 1).alias("far")))
    open_ = settle(vectors.select("node", size.alias("size"), F.explode(trees).alias("t")).select("node", "size", "t.tree", "t.near", "t.far"))
    visits = open_.select("node", "size", "tree", F.col("near").alias("bits"), F.lit(True).alias("home")).unionByName(open_.select("node", "size", "tree", F.col("far").alias("bits"), F.lit(False).alias("home")))
    depth, found = 0, None
    while True:
        name = F.concat_ws(":", "size", "tree", F.substring("bits", 1, depth))
        named = visits.withColumn("leaf", name)
        counts = named.where("home").groupBy("leaf").agg(F.count("*").alias("n"))
        if depth == BITS:
            blocks = counts.select("leaf", F.ceil(F.col("n") / LEAF).alias("blocks"))
            last = named.join(blocks, "leaf").withColumn("leaf", F.concat_ws(":", "leaf", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("string")))
            return found.unionByName(last.select("node", "leaf", "home")) if found is not None else last.select("node", "leaf", "home")
        split = named.join(counts, "leaf")  # a visitor of a leaf without owners finds nobody there
        done = settle(split.where(F.col("n") <= LEAF).select("node", "leaf", "home"))
        found = done if found is None else found.unionByName(done)
        visits = settle(split.where(F.col("n") > LEAF).select("node", "size", "tree", "bits", "home"))
        if not visits.limit(1).count():
            return found
        depth = min(BITS, depth + STEP)


def nearest(df: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(edges, members): node, other, cosine of the k best of each node (of equals, the smallest names); id, node. df: id, vector."""
    vectors, members = nodes(df)
    kind = df.schema["id"].dataType.simpleString()
    dealt = leaves(vectors).join(vectors.select("node", "vector"), "node").select("leaf", "node", "home", "vector")

    def compare(group: pa.Table) -> pa.Table:
        names, home = np.array(group.column("node").to_pylist()), group.column("home").to_numpy(zero_copy_only=False)
        v = np.frombuffer(b"".join(group.column("vector").to_pylist()), float).reshape(len(names), -1)
        own, out = np.flatnonzero(home), ([], [], [])
        for at in range(0, len(names), 256):
            cosines = v[at : at + 256] @ v[own].T
            for i, row in enumerate(cosines, at):
                row[names[own] == names[i]] = -2
                best = np.argpartition(-row, min(k, len(row) - 1))[: k + 1] if len(row) > k else np.arange(len(row))
                edge = np.sort(row[best])[::-1][min(k, len(best)) - 1]
                best = np.flatnonzero(row >= edge)  # with all that tie for the last place
                best = best[np.lexsort((names[own][best], -row[best]))][:k]
                best = best[row[best] > -2]
                out[0].extend([names[i]] * len(best))
                out[1].extend(names[own][best].tolist())
                out[2].extend(row[best].tolist())
        at = group.schema.field("node").type
        return pa.table({"node": pa.array(out[0], at), "other": pa.array(out[1], at), "cosine": pa.array(out[2], pa.float64())})

    found = dealt.groupBy("leaf").applyInArrow(compare, f"node {kind}, other {kind}, cosine double")
    once = found.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    best = once.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("apart"), "other"))), 1, k).alias("x"))  # of 2 * TREES * k at most
    return settle(best.select("node", F.explode("x").alias("x")).select("node", "x.other", (-F.col("x.apart")).alias("cosine"))), settle(members)


def propagate(edges: DataFrame, least: float = 0.0, rounds: int = 30) -> DataFrame:
    """(node, label) along edges (node, other, cosine) of at least that cosine, both ways; nodes without edges are not in it."""
    near = edges.where(F.col("cosine") >= least)
    ways = near.select("node", "other", "cosine").unionByName(near.select(F.col("other").alias("node"), F.col("node").alias("other"), "cosine"))
    ways = settle(ways.groupBy("node", "other").agg(F.round(F.max("cosine"), 9).cast("decimal(12,9)").alias("w")))  # decimals: sums don't depend on their order
    top = ways.groupBy("node").agg(F.max("w").alias("w"))
    labels = settle(top.select("node", F.col("node").alias("label"), "w"))
    for _ in range(rounds):
        votes = ways.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label", "w").unionByName(labels.select("node", "label", "w"))
        sums = votes.groupBy("node", "label").agg(F.sum("w").alias("s"))
        most = sums.groupBy("node").agg(F.min_by("label", F.struct((-F.col("s")).alias("s"), "label")).alias("label"))
        now = settle(most.join(top, "node").select("node", "label", "w"))
        changed = now.join(labels.select("node", F.col("label").alias("was")), "node").where("label <> was").limit(1).count()
        labels = now
        if not changed:
            break
    return labels.select("node", "label")


def embedding_clusters(df: DataFrame, k: int = 10, least: float = 0.5, rounds: int = 30) -> DataFrame:
    """(id, cluster) of every row of df (id, vector): the smallest id that carries the same label; a row that is no node, or has no neighbour, is its own cluster."""
    edges, members = nearest(df, k)
    labels = propagate(edges, least, rounds)
    own = members.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("label"))
    every = settle(df.select("id").join(own, "id", "left").select("id", F.coalesce("label", "id").alias("label")))
    return every.join(every.groupBy("label").agg(F.min("id").alias("cluster")), "label").select("id", "cluster")
