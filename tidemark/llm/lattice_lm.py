"""Language-model scoring by a subword lattice (operator 3).

A document's probability is the product over its words of the word's marginal over all segmentations into pieces of an
existing vocabulary, and of the end piece. The forward recursion runs in log space over each distinct word once. Piece
weights start from the vocabulary's own scores (a unigram model's log probabilities; a merge vocabulary's ranks read as
a Zipf law) as pseudo-counts, and are updated with the counts of pieces in the training words.

The words of all documents are counted by an aggregation that grows with the corpus. The most frequent words' scores
(HOT_WORDS at most) are broadcast; the others reach their documents by a join on the word, so that no table that grows
with the corpus is broadcast and no frequent word is a hot key.

Edge cases: a null or empty text has one token, the end; rows with a null doc_id are scored but not learned from and
count as not held out; repeated rows get repeated results; without training rows all counts are 0; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import compress, repeat
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, rows, ship, spool

#: Words whose scores are broadcast, at most (a few MB); longer words are never among them.
HOT_WORDS = 200_000
HOT_BYTES = 64
#: Distinct words a task holds before it passes its counts on.
FLUSH = 400_000
#: Weight of the vocabulary's own scores, in pieces.
PRIOR = 32_000.0
#: The end token; no word holds a blank.
END = " "
LOG10 = log(10)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


class Lattice:
    """Trie over a vocabulary's pieces, with log probabilities."""

    def __init__(self, model: bytes, piece_counts: np.ndarray | None = None):
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        scores = np.array([sp.get_score(k) for k in range(n)])
        special = np.array([sp.is_control(k) or sp.is_unknown(k) for k in range(n)])
        byte = np.array([sp.is_byte(k) for k in range(n)])
        if (scores <= 0).all() and (scores == np.floor(scores)).all():  # ranks of merges
            scores = -np.log(2.7 - scores)
            scores[byte] = scores[~byte].min()
        prior = np.where(special, 0.0, np.exp(scores))
        prior[sp.eos_id()] = prior.max()
        prior /= prior.sum()
        counts = np.zeros(n) if piece_counts is None else piece_counts
        p = (counts + PRIOR * prior) / (counts.sum() + PRIOR)
        self.end = log(p[sp.eos_id()])
        self.bytes = [0.0] * 256
        self.trie: dict = {}
        for k in range(n):
            if byte[k]:
                self.bytes[int(sp.id_to_piece(k)[3:5], 16)] = log(p[k])
            elif not special[k]:
                node = self.trie
                for ch in sp.id_to_piece(k):
                    node = node.setdefault(ch, {})
                node[""] = log(p[k])

    def word(self, word: str) -> float:
        """Natural log of the word's probability: log-space forward recursion over all segmentations."""
        s = "▁" + word
        n, trie = len(s), self.trie
        alpha: list = [None] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if s[i] not in trie or "" not in trie[s[i]]:  # not in the vocabulary: its bytes
                v, b = a + sum(self.bytes[x] for x in s[i].encode()), alpha[i + 1]
                alpha[i + 1] = v if b is None else v + log1p(exp(b - v)) if v > b else b + log1p(exp(v - b))
            node = trie
            for j in range(i, n):
                if (node := node.get(s[j])) is None:
                    break
                if "" in node:
                    v, b = a + node[""], alpha[j + 1]
                    if b is None:
                        alpha[j + 1] = v
                    elif v > b:
                        alpha[j + 1] = v + log1p(exp(b - v))
                    else:
                        alpha[j + 1] = b + log1p(exp(v - b))
        return alpha[n]


_BUILT: dict[bytes, Lattice] = {}


def built(model: bytes, piece_counts: np.ndarray | None = None) -> Lattice:
    key = hashlib.md5(model + (b"" if piece_counts is None else piece_counts.tobytes())).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Lattice(model, piece_counts)
    return _BUILT[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every word of all documents and the end, with its count in training documents. docs: text, train."""

    def count(batches):
        train, other = Counter(), Counter()

        def flush():
            for counter, weight in ((train, 1), (other, 0)):
                words = list(counter)
                for at in range(0, len(words), 50_000):
                    part = words[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counter[w] * weight for w in part], pa.int64())], names=["word", "c"])
                counter.clear()

        for batch in batches:
            for text, use in rows(batch):
                (train if use else other).update([*words_of(text), END.encode()])
                if len(train) + len(other) > FLUSH:
                    yield from flush()
        yield from flush()

    return docs.select("text", "train").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, model) -> np.ndarray:
    """Count of each piece of the vocabulary (a bounded table) in the training words, each segmented by the vocabulary."""

    def count(batches):
        lattice = built(model.value)
        size, eos = lattice.sp.get_piece_size(), lattice.sp.eos_id()
        total = np.zeros(size)
        for batch in batches:
            word, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in range(0, len(word), 2000):
                encoded = lattice.sp.encode(word[at : at + 2000], num_threads=1)
                ends = c[at : at + 2000][[w == END for w in word[at : at + 2000]]].sum()
                lengths = [0 if w == END else len(e) for w, e in zip(word[at : at + 2000], encoded, strict=True)]
                flat = [k for w, e in zip(word[at : at + 2000], encoded, strict=True) if w != END for k in e]
                if flat:
                    total += np.bincount(flat, weights=np.repeat(c[at : at + 2000], lengths), minlength=size)
                total[eos] += ends
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "n"])

    found = words.where("c > 0").select("word", "c").mapInArrow(count, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(built(model.value).sp.get_piece_size())
    for x in found:
        out[x.piece] = x.n
    return out


def word_scores(words: DataFrame, model, pieces: np.ndarray) -> DataFrame:
    """(word, c, lm): log10 of each word's marginal probability, the end piece's for the end token."""
    shipped = words.sparkSession.sparkContext.broadcast(pieces)

    def score(batches):
        lattice = built(model.value, shipped.value)
        for batch in batches:
            lm = [(lattice.end if w == END else lattice.word(w)) / LOG10 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lm)], names=["word", "c", "lm"])

    return words.select("word", "c").mapInArrow(score, "word string, c long, lm double")


def hot_threshold(words: DataFrame, most: int) -> int:
    """The least count so that at most `most` words have it or more (1 at least, rounded up to a quarter octave)."""
    step = F.ceil(F.log2("c") * 4)
    by = sorted(((r.b, r.n) for r in words.where("c > 0").groupBy(step.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for b, n in by:  # a few hundred rows
        if (total := total + n) > most:
            break
        least = b
    return 1 << 62 if least is None else max(1, int(2 ** ((least - 1) / 4)) + 1) if least > 0 else 1


def score_documents(docs: DataFrame, model_path: str, fold: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    model = ship(spark, model_path)
    out = F.coalesce(crc_mod(F.col("doc_id"), fold) == held, F.lit(False))
    docs = docs.select("doc_id", "text", out.alias("held_out"), (F.col("doc_id").isNotNull() & ~out).alias("train"))
    counted = spool(word_counts(docs))
    total = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    words = spool(word_scores(counted, model, piece_counts(counted, model)).withColumn("base", F.log10((F.col("c") + 1) / F.lit(float(total.n + total.v + 1)))))
    least = hot_threshold(words, HOT_WORDS)
    hot = words.where((F.col("c") >= least) & (F.octet_length("word") <= HOT_BYTES)).select("word", "base", "lm").toArrow()
    shipped = spark.sparkContext.broadcast((hot["word"].to_pylist(), hot["base"].to_numpy(), hot["lm"].to_numpy()))
    names = ["word", "row", "n", "doc_id", "held_out", "n_tokens", "n_known", "base", "lm"]

    def occurrences(batches):
        word, base, lm = shipped.value
        get = {w.encode(): k for k, w in enumerate(word)}.get
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            types = [pa.string(), pa.int64(), pa.int64(), batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            found: list[list] = [[] for _ in names]
            for doc_id, text, held_out in rows(batch):
                row += 1
                tokens = [*words_of(text), END.encode()]
                k = np.fromiter(map(get, tokens, repeat(-1)), np.int64, len(tokens))
                known = k[k >= 0]
                record = [(f" {row}", row, 0, doc_id, held_out, len(tokens), len(known), float(base[known].sum()), float(lm[known].sum()))]
                record += [(w.decode(), row, n, None, None, None, None, None, None) for w, n in Counter(compress(tokens, (k < 0).tolist())).items()]
                for column, values in zip(found, zip(*record, strict=True), strict=True):
                    column.extend(values)
                if len(found[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=names)
                    found = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types, strict=True)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"word string, row long, n long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, lm double"
    seen = docs.select("doc_id", "text", "held_out").mapInArrow(occurrences, schema).alias("o")
    w = words.alias("w")
    joined = seen.join(w, F.col("o.word") == F.col("w.word"), "left").select(
        "o.row", "o.doc_id", "o.held_out", "o.n_tokens",
        F.coalesce("o.n_known", F.when(F.col("w.c") > 0, F.col("o.n")), F.lit(0)).alias("n_known"),
        F.coalesce("o.base", F.col("o.n") * F.col("w.base")).alias("base"), F.coalesce("o.lm", F.col("o.n") * F.col("w.lm")).alias("lm"),
    )
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("lm").alias("score"),
    ).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), "base_score", "score")
