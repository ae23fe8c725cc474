"""Language identification (operator 10).

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
(FTRL-proximal, elastic-net penalties), then temperature calibration on a part of the sample kept out of training.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE, those with the smallest hash of their id);
executors turn their whole texts into sparse counts over DIMENSIONS features, and only those go to the driver.
Predictions read every row's whole text.

Edge cases: a null text, or one without a letter, is `und` with score 0; rows with a null doc_id or lang aren't learned
from; without any labelled row everything is `und`; repeated rows get repeated results; ties go to the label that sorts
first; incoming columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import crc_mod, rows

#: Labelled rows that the classifier is fitted on, at most; one in five of them calibrates the temperature.
SAMPLE = 4000
#: Hashed features.
DIMENSIONS = 1 << 15
#: Characters featurised at once.
BLOCK = 1 << 20
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def counts(text: str) -> np.ndarray | None:
    """Occurrences of each hashed 1- to 3-gram of lower-case characters, non-letters as blanks; None without a letter."""
    if not _LETTER:
        _LETTER.append(_letters())
    total, found, lower = np.zeros(DIMENSIONS, np.int64), False, text.lower()
    for at in range(0, len(lower), BLOCK):
        code = np.frombuffer(lower[max(0, at - 2) : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[0][code]
        found |= bool(letter[min(at, 2) :].any())
        code = np.where(letter, code, np.uint32(32))
        two = code[:-1] * np.uint32(0x9E3779B1) ^ code[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) ^ code[2:] * np.uint32(0x27D4EB2F)
        for k, grams in enumerate((code * np.uint32(0x165667B1), two, three)):
            new = grams[max(0, min(at, 2) - k) :]
            total += np.bincount((new * np.uint32(0x2C1B3C6D)) >> np.uint32(17), minlength=DIMENSIONS)
    return total if found else None


@dataclass
class Model:
    """weights: idf times coefficient by feature and label; idf by feature; temperature divides the scores."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[index]
        return (x / np.sqrt((x * x).sum())) @ self.weights[index] + self.bias

    def probabilities(self, index: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = self.logits(index, count) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        seen = counts(text) if text and self.labels else None
        if seen is None:
            return UNDETERMINED, 0.0
        index = np.flatnonzero(seen)
        p = self.probabilities(index, seen[index])
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]], alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=3) -> Model:
    """sample: label, feature indices, counts; in a fixed order."""
    labels = sorted({x[0] for x in sample})
    if not labels:
        return Model([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    train = [x for k, x in enumerate(sample) if k % 5 or len(sample) < 10]
    held = [x for k, x in enumerate(sample) if not k % 5 or len(sample) < 10]
    df = np.zeros(DIMENSIONS)
    for _, index, _ in train:
        df[index] += 1
    model = Model(labels, np.zeros((DIMENSIONS, len(labels))), np.zeros(len(labels)), np.log((1 + len(train)) / (1 + df)) + 1)
    z, n = np.zeros((DIMENSIONS + 1, len(labels))), np.zeros((DIMENSIONS + 1, len(labels)))  # the last is the bias

    def weights(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(train)):  # the weighted features are made again each time: the counts take less memory
            label, index, count = train[k]
            x = np.log1p(count) * model.idf[index]
            i, x = np.append(index, DIMENSIONS), np.append(x / np.sqrt((x * x).sum()), 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels.index(label)] -= 1
            g = x[:, None] * p
            g2 = n[i] + g * g
            z[i] += g - (np.sqrt(g2) - np.sqrt(n[i])) / alpha * w
            n[i] = g2
    final = weights(np.arange(DIMENSIONS + 1))
    model.weights, model.bias = final[:-1], final[-1]
    scores = np.array([model.logits(i, c) for _, i, c in held])
    truth = np.array([labels.index(label) for label, *_ in held])

    def loss(t):
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    model.temperature = min(np.exp(np.linspace(np.log(0.02), np.log(5), 100)).tolist(), key=loss)
    return model


def learn(docs: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows of those usable that have a text and a lang."""
    rank = F.xxhash64("doc_id")
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # ordered by content as well, so that the bound cuts rows of one id the same way each time
    own, content = rank.alias("r"), F.xxhash64("lang", "text").alias("t")
    last = labelled.select(own, content).orderBy("r", "t").limit(sample).agg(F.max(F.struct("r", "t"))).first()[0]
    if last is None:
        return fit([])

    def featurise(batches):
        for batch in batches:
            out = []
            for r, lang, text in rows(batch):
                if (seen := counts(text)) is not None:
                    index = np.flatnonzero(seen)
                    out.append((r, lang, index.astype("<u2").tobytes(), seen[index].astype("<u4").tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["r", "lang", "index", "count"])

    drawn = labelled.select(own, content, "lang", "text").where((F.col("r") < last.r) | (F.col("r") == last.r) & (F.col("t") <= last.t)).dropDuplicates(["r", "t"])
    found = drawn.select("r", "lang", "text").mapInArrow(featurise, "r long, lang string, index binary, count binary").toArrow()  # at most `sample` rows
    in_order = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True))
    return fit([(lang, np.frombuffer(index, "<u2"), np.frombuffer(count, "<u4")) for _, lang, index, count in in_order])


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score, under these names; columns of docs that have them go."""
    docs = docs.drop(*names)
    had, at = docs.columns, docs.columns.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        own = shipped.value
        for batch in batches:
            texts = batch.column(at)
            found = [own.predict(texts[k].as_py()) for k in range(batch.num_rows)]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*had, *names])

    return docs.toDF(*(f"c{k}" for k in range(len(had)))).mapInArrow(predict, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def language_id(docs: DataFrame, fold: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only from rows whose crc32 of the id isn't `held` modulo `fold`."""
    out = crc_mod(F.col("doc_id"), fold) == held
    model = learn(docs, ~out)
    return identify(docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
