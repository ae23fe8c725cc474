"""Connected components by alternating stars, and blockwise work on the groups of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of edges (a, b), the smallest node reachable from it.

    Large-star and small-star steps alternate until the edges are stars; each round is written to the shared folder.
    Hot nodes meet only in map-side minima and joins, whose skewed partitions can be split.
    """
    e = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = spool(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = spool(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node has one edge down, and no node with an edge down is the lower end of another."""
    ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    counted = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return counted.where("up > 1 or up > 0 and low > 0").limit(1).count() == 0


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work on each group of equal long keys, whose size the caller has bounded; groups come in turn from sorted partitions."""
    k = len(keys)

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(i).to_numpy() for i in range(k)], 1)
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1), len(own)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(own[a])
                if last is not None and key != last:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = key
        if held:
            yield from work(pa.Table.from_batches(held))

    first = [*keys, *(c for c in df.columns if c not in keys)]
    return df.select(*first).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def fixed(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)
