"""Exact token counts by a length histogram (operator 6).

Documents are aggregated by encoded length; all totals, quantiles and truncated totals then come from the histogram by
suffix sums. Between two lengths that occur, every figure is linear in the context limit, so that one row for each
length holds the answer for every limit (see at_limit).

Edge cases: a null or empty text has length 0; an empty table gives no rows; only the text is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import token_lengths
from .common import spool

#: Lengths in one block of the two-level suffix sums: a task sums one block, and one row for each block meets in the last.
BLOCK = 4096


def length_histogram(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. Written once, so that no later use encodes the texts anew."""
    return spool(token_lengths(docs, ranks_path, pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For each occurring length L as a context limit.

    context_limit, n_docs (of that length), docs_total, docs_over (longer than L), tokens_total (untruncated),
    tokens_truncated (each document cut to L tokens), tokens_lost, quantile (share of documents of at most L tokens).
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    over = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt")).select(
        "block", F.coalesce(F.sum("bd").over(over), F.lit(0)).alias("above_docs"), F.coalesce(F.sum("bt").over(over), F.lit(0)).alias("above_tokens"),
        F.sum("bd").over(Window.partitionBy()).alias("docs_total"), F.sum("bt").over(Window.partitionBy()).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    t = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "docs_total", "tokens_total",
        (F.col("above_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("above_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_over"),
    )
    truncated = F.col("tokens_total") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")
    return t.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", "docs_total", "docs_over", "tokens_total", truncated.alias("tokens_truncated"),
        (F.col("tokens_total") - truncated).alias("tokens_lost"), ((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total")).alias("quantile"),
    )


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """tokens_truncated and docs_over for any limit, from limit_table: one row (none if no document is there)."""
    below = table.where(F.col("context_limit") <= limit).agg(F.max_by(F.struct("docs_over", "tokens_truncated"), "context_limit").alias("b"), F.max("context_limit").alias("at"))
    total = table.agg(F.max("docs_total").alias("docs_total")).where("docs_total is not null")
    over = F.coalesce("b.docs_over", "docs_total")
    return total.crossJoin(below).select(  # one row each
        F.lit(limit).cast("long").alias("context_limit"), over.alias("docs_over"),
        (F.coalesce("b.tokens_truncated", F.lit(0)) + over * (F.lit(limit) - F.coalesce("at", F.lit(0)))).cast("long").alias("tokens_truncated"),
    )
