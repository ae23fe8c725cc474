"""Run-over-run comparison and input audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representatives(df: DataFrame, key: str = "keyword") -> DataFrame:
    """One row for each key: largest volume, then first source, then first row."""
    fields = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(-F.coalesce("volume", F.lit(0)), F.col("source"), F.col("kw_idx"))).alias("r"))
    return best.select(key, "r.*")


def paired(base: DataFrame, current: DataFrame, fields: list[str], key: str = "keyword") -> DataFrame:
    """Full outer pairing: key, b_* and c_* fields, in_base, in_current."""
    b = base.select(key, *(F.col(c).alias(f"b_{c}") for c in fields), F.lit(True).alias("in_base"))
    c = current.select(key, *(F.col(x).alias(f"c_{x}") for x in fields), F.lit(True).alias("in_current"))
    return b.join(c, key, "full_outer").withColumns({"in_base": F.coalesce("in_base", F.lit(False)), "in_current": F.coalesce("in_current", F.lit(False))})


def changes(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, added, dropped) of the keys that only one run has."""
    keys = [df.select(key).distinct() for df in (base, current)]
    only = lambda df, other, added: df.join(other, key, "left_anti").select(key, F.lit(added).alias("added"), F.lit(not added).alias("dropped"))
    return only(keys[1], keys[0], True).unionByName(only(keys[0], keys[1], False))


def samples(found: DataFrame, key: str, n: int = 20) -> DataFrame:
    """(change, rank, key): the first n of added and of dropped keys, in order of the key; found: see changes."""
    change = F.when(F.col("added"), "added").otherwise("dropped")
    order = Window.partitionBy("change").orderBy(key)
    return found.select(change.alias("change"), key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)  # each task hands on its first n


def resolution() -> Column:
    """Movement of a quick win between two runs, over paired()'s columns."""
    was, is_ = F.coalesce(F.col("b_quick_win") == "quick_win", F.lit(False)), F.coalesce(F.col("c_quick_win") == "quick_win", F.lit(False))
    return (
        F.when(is_ & was, "still").when(is_, "newly").when(~was, None).when(~F.col("in_current"), "left_corpus").when(F.col("c_position") <= 3, "captured")
        .when(F.col("c_position") < F.col("b_position"), "still_climbing").when(F.col("c_position") > F.col("b_position"), "regressed").otherwise("reclassified")
    )


def score_deltas(pairs: DataFrame, names: list[str]) -> DataFrame:
    """One row: mean change of each score over shared keys."""
    both = pairs.where("in_base and in_current")
    return both.agg(F.count("*").alias("shared"), *(F.round(F.avg(F.col(f"c_{n}") - F.col(f"b_{n}")), 2).alias(f"delta_{n}") for n in names))


def movers(pairs: DataFrame, score: str, up: bool, n: int = 15) -> DataFrame:
    delta = F.round(F.col(f"c_{score}") - F.col(f"b_{score}"), 1)
    got = pairs.where("in_base and in_current").select("keyword", delta.alias("delta")).where("delta > 0" if up else "delta < 0")
    return got.orderBy(F.col("delta").desc() if up else F.col("delta"), "keyword").limit(n)


def audit_rows(df: DataFrame) -> DataFrame:
    """One row of counts. df: keyword, volume, difficulty, position."""
    empty = F.coalesce(F.trim("keyword") == "", F.lit(True))
    per = df.where(~empty).groupBy("keyword").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    figures = df.agg(
        F.count("*").alias("total"), F.count_if(empty).alias("empty"), F.count_if(F.length("keyword") > 200).alias("too_long"), F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if((F.col("difficulty") < 0) | (F.col("difficulty") > 100)).alias("bad_difficulty"), F.count_if((F.col("position") < 1) | (F.col("position") > 100)).alias("bad_position"),
    )
    return figures.crossJoin(F.broadcast(per))  # two rows of counts


def findings(figures: DataFrame) -> DataFrame:
    """(severity, category, n) from the counts of audit_rows."""
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    rules = [
        ("no_data_rows", F.col("total") == 0, F.lit("CRITICAL"), F.col("total")), ("empty_keywords", F.col("empty") > 0, F.when(share("empty") < 0.1, "WARNING").otherwise("CRITICAL"), F.col("empty")),
        ("many_duplicates", share("duplicates") > 0.05, F.lit("WARNING"), F.col("duplicates")), ("keyword_too_long", F.col("too_long") > 0, F.lit("WARNING"), F.col("too_long")),
        ("negative_volume", F.col("negative_volume") > 0, F.lit("WARNING"), F.col("negative_volume")), ("out_of_range_difficulty", F.col("bad_difficulty") > 0, F.lit("WARNING"), F.col("bad_difficulty")),
        ("out_of_range_position", F.col("bad_position") > 0, F.lit("WARNING"), F.col("bad_position")),
    ]
    each = F.array(*(F.when(test, F.struct(level.alias("severity"), F.lit(name).alias("category"), n.cast("long").alias("n"))) for name, test, level, n in rules))
    return figures.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.*")


def source_concentration(df: DataFrame) -> DataFrame:
    """(source, share) of a source with over nine tenths of the rows."""
    counts = df.groupBy("source").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).where("k > 1 and n > 0.9 * t").select("source", F.round(F.col("n") / F.col("t"), 4).alias("share"))  # one row


def intent_shift(base: DataFrame, current: DataFrame, column: str = "query_type") -> DataFrame:
    """(value, base, current, delta) over the union of both runs' values."""
    b, c = (df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias(n)) for df, n in ((base, "base"), (current, "current")))
    both = b.join(c, "value", "full_outer").select("value", F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("current", F.lit(0)).alias("current"))
    return both.withColumn("delta", F.col("current") - F.col("base"))


def gap_changes(base: DataFrame, current: DataFrame) -> DataFrame:
    """Gaps (gap, n, samples joined by a bar) of two runs: counts, their change, samples closed and opened, and whether those are partial."""
    side = lambda df, p: df.select("gap", F.col("n").alias(f"{p}_count"), F.split("samples", r"\|").alias(f"{p}_s"))
    both = side(base, "base").join(side(current, "current"), "gap", "full_outer")
    none = F.array().cast("array<string>")
    b, c = (F.array_distinct(F.coalesce(f"{p}_s", none)) for p in ("base", "current"))
    capped = lambda p, s: F.coalesce(F.col(f"{p}_count"), F.lit(0)) > F.size(s)
    listed = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), "|")
    return both.select(
        "gap", F.coalesce("base_count", F.lit(0)).alias("base_count"), F.coalesce("current_count", F.lit(0)).alias("current_count"),
        (F.coalesce("current_count", F.lit(0)) - F.coalesce("base_count", F.lit(0))).alias("delta"), listed(b, c).alias("closed"), listed(c, b).alias("opened"), (capped("base", b) | capped("current", c)).alias("partial"),
    )
