"""Training-corpus preparation: language ID, MinHash near-dedup, PII redaction, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, read, spool
from tidemark.llm.language_id import UNDETERMINED, identify, learn
from tidemark.llm.minhash import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.pii import redact
from tidemark.llm.queries import WORD_MODEL

#: Documents whose language is less probable than this are rejected, as those without a letter are.
LEAST_SCORE = 0.5
#: Reserved names, which no table has, for the language stage's own columns.
NAMES = ("language id: language", "language id: score")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; the identifier learns from two folds of three.

    Null, empty and letterless texts go; a null id counts as a fold that isn't learned from; rows that repeat stay or go
    together; without rows to learn from, none has a language; all columns are handed on, whatever their names.
    """
    model = learn(docs, crc_mod(F.col("doc_id"), 3) != 1)
    named = identify(docs, model, NAMES)
    return named.where((F.col(NAMES[0]) != UNDETERMINED) & (F.col(NAMES[1]) >= LEAST_SCORE)).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of near copies the row with the smallest id: five-word shingles, similarity 0.8 or more.

    Rows that repeat an id, or have none, are told apart (see one_of_each); texts without words are no copies.
    """
    return one_of_each(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; no document goes. n_chars follows the text; a null text stays null."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences; null texts are empty, null ids and repeated rows are documents of their own."""
    return pack(docs, WORD_MODEL)


STAGES = [("language_id", language), ("minhash_near_dedup", near_dedup), ("pii", personal_data), ("best_fit_packing", best_fit)]
#: SQL can't express the tokenizer or the trained models; tests/llm/test_pipeline.py compares each stage with brute force (language with the trained model row by row, personal data by the rules' spans).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
