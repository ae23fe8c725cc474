"""Statistical keyphrases: words are scored by casing, position, frequency and the variety of their context, phrases by their words.

The word score is that of YAKE (Campos and others, 2020), taken over a corpus: a word that is often written in capitals,
comes early in its rows, is frequent and spread over sentences, and has few different neighbours for its frequency, scores
low, and low is good. A phrase's score is the product of its words' over its frequency and their sum. Phrases with the same
words in any order, but for a plural s, are near-duplicates, of which the best stays.

Everything is a grouped count, and no shuffle carries the occurrences themselves: phrases are counted by row where the
row's text is, and by (phrase, sentence number) within each task first. Neighbours are counted by (word, neighbour) before they are counted by word, and medians
keep one entry for each sentence number, so that a word that is everywhere arrives as one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .clusters import settle

#: A sentence is what lies between these marks.
SENTENCE = r"[^.!?\n]+"
#: The tokens of two characters or more.
WORD = r"[\p{L}\p{N}_]{2,}"


def no_stop_words(language: Column, words: str = "t") -> Column:
    """Which of the words are no stop words of the row's language, or of any language where it isn't known; looked up in hash sets."""
    every = {w for ws in L.ENTITY_STOPS.values() for w in ws}
    by = [F.when(F.lower(language) == c, F.transform(words, _not_in(ws))) for c, ws in L.ENTITY_STOPS.items()]
    return F.coalesce(*by, F.transform(words, _not_in(every)))


def _not_in(words):
    return lambda t: ~t.isin(*sorted(words))


def sentences(df: DataFrame) -> DataFrame:
    """(kw_idx, sentence, raw, keep): words of two characters or more in each sentence, as written, and which are no stop words."""
    split = df.select("kw_idx", "language", F.posexplode_outer(F.regexp_extract_all("keyword", F.lit(SENTENCE), F.lit(0))).alias("sentence", "s")).where("s is not null")
    out = split.select("kw_idx", "sentence", "language", F.regexp_extract_all("s", F.lit(WORD), F.lit(0)).alias("raw")).where(F.size("raw") > 0).withColumn("t", F.transform("raw", F.lower))
    return out.select("kw_idx", "sentence", "raw", no_stop_words(F.col("language")).alias("keep"))


def words(parts: DataFrame, following: int, *carried: str) -> DataFrame:
    """(carried, raw, keep, n1, k1, ..., inner): each word, the words after it with their keep, and whether another comes before it.

    Zipped arrays are exploded by generated code, lambda functions are not; of a plain explode Spark infers a filter by
    size, which would make all of this twice.
    """
    after = (F.slice(c, k + 1, F.size("raw")).alias(f"{name}{k}") for k in range(1, following + 1) for c, name in (("raw", "n"), ("keep", "k")))
    zipped = F.arrays_zip("raw", "keep", *after)
    return parts.select(*carried, F.posexplode_outer(zipped).alias("i", "w")).where("w is not null").select(*carried, "w.*", (F.col("i") > 0).alias("inner"))


def _variety(parts: DataFrame) -> DataFrame:
    """(term, left, right): different neighbours on each side over all of them, null where there are none. Both sides count the same pairs."""
    near = words(parts, 1).where("n1 is not null and (keep or k1)").groupBy(F.lower("raw").alias("a"), F.lower("n1").alias("b")).agg(F.count_if("k1").alias("l"), F.count_if("keep").alias("r"))
    none = F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("a").alias("term"), none.alias("l"), "r"), F.struct(F.col("b").alias("term"), "l", none.alias("r")))
    side = lambda c: F.try_divide(F.count_if(F.col(c) > 0), F.sum(c)).alias({"l": "left", "r": "right"}[c])
    return near.select(F.explode_outer(ends).alias("e")).select("e.*").where("l + r > 0").groupBy("term").agg(side("l"), side("r"))


def word_scores(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, s) and (term, at) of every word that is no stop word: its score and its median sentence; parts: see sentences."""
    term, head = F.lower("raw").alias("term"), F.substring("raw", 1, 1)
    capital, acronym = F.col("inner") & (head != F.lower(head)), (F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw"))
    counted = words(parts, 0, "sentence").where("keep").groupBy(term, "sentence").agg(F.count("*").alias("tf"), F.count_if(capital).alias("capital"), F.count_if(acronym).alias("acronym"))
    once = F.array_distinct(F.transform("raw", lambda x, i: F.when(F.get("keep", i), F.lower(x))))
    spread = parts.select(F.explode_outer(once).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("spread"))
    found = counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.greatest(F.sum("capital"), F.sum("acronym")).alias("cased"), F.percentile("sentence", F.lit(0.5), F.col("tf")).alias("at"))
    found = settle(found.join(spread, "term"))  # read three times
    total = found.agg((F.avg("tf") + F.stddev_pop("tf")).alias("usual"), F.max("tf").alias("most")).crossJoin(parts.agg(F.count("*").alias("sentences")))  # one row
    got = found.join(_variety(parts), "term", "left").crossJoin(F.broadcast(total))
    related = 1 + (F.coalesce("left", F.lit(0.0)) + F.coalesce("right", F.lit(0.0))) * F.col("tf") / F.col("most")
    spread = F.col("cased") / (1 + F.ln("tf")) + (F.col("tf") / F.col("usual") + F.col("spread") / F.col("sentences")) / F.col("related")
    return got.withColumn("related", related).select("term", (F.col("related") * F.ln(F.ln(3 + F.col("at"))) / spread).alias("s")), found.select("term", "at")


def phrases(parts: DataFrame, sizes: range, *carried: str) -> DataFrame:
    """(carried, term): runs of so many adjacent words of a sentence that are no stop words."""
    grams, term, kept = [], F.lower("raw"), F.col("keep")
    for n in range(1, sizes.stop):
        if n > 1:
            term, kept = F.concat(term, F.lit(" "), F.lower(f"n{n - 1}")), kept & F.col(f"k{n - 1}")
        if n in sizes:
            grams.append(F.when(kept, term))
    return words(parts, sizes.stop - 2, *carried).select(*carried, F.explode_outer(F.array(*grams)).alias("term")).where("term is not null")


def signature(term: Column) -> Column:
    """The phrase's different words in order of the alphabet, without a plural s after three letters."""
    bare = F.transform(F.split(term, " "), lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.left(t, F.length(t) - 1)).otherwise(t))
    return F.array_join(F.sort_array(F.array_distinct(bare)), " ")


def keyphrases(df: DataFrame, min_df: int = 2, max_ngram: int = 2) -> DataFrame:
    """term, tf, df, idf, position_factor, score of phrases in at least min_df rows; score is less the logarithm of the phrase's score, so that high is good.

    df: kw_idx, keyword (a text of any length), language. Null and empty texts have no phrases; position_factor is
    ln(ln(3 + median sentence)) of the phrase. Of near-duplicates the one with the best score stays, of equals the first in
    the alphabet.
    """
    parts = settle(sentences(df.repartition("kw_idx")))  # cut once, by even tasks: all aggregates start from it
    per = phrases(parts.repartition("kw_idx"), range(1, max_ngram + 1), "kw_idx").groupBy("term", "kw_idx").agg(F.count("*").alias("tf"))  # the texts are shuffled, their phrases are not
    rows = settle(per.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df")).where(F.col("df") >= min_df))
    scores, middle = word_scores(parts)
    if max_ngram > 1:
        found = phrases(parts, range(2, max_ngram + 1), "sentence")
        places = found.groupBy("term", "sentence").agg(F.count("*").alias("n")).join(rows.select("term"), "term")  # only of terms that stay
        middle = middle.unionByName(places.groupBy("term").agg(F.percentile("sentence", F.lit(0.5), F.col("n")).alias("at")))
    each = rows.select("term", F.explode(F.split("term", " ")).alias("word")).join(scores.withColumnRenamed("term", "word"), "word")
    combined = each.groupBy("term").agg(F.sum(F.ln("s")).alias("product"), F.sum("s").alias("sum"))
    total = df.agg(F.count("*").alias("n"))  # one row of one number
    got = rows.join(combined, "term").join(middle, "term").crossJoin(F.broadcast(total))
    got = got.select(
        "term", "tf", "df", F.round(F.ln(F.col("n") / F.col("df")), 6).alias("idf"), F.round(F.ln(F.ln(3 + F.col("at"))), 6).alias("position_factor"),
        F.round(F.ln("tf") + F.ln(1 + F.col("sum")) - F.col("product"), 6).alias("score"),
    )
    best = got.groupBy(signature(F.col("term")).alias("signature")).agg(F.min_by(F.struct(*got.columns), F.struct(-F.col("score"), "term")).alias("x"))
    return best.select("x.*")
