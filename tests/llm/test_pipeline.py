"""The corpus pipeline, stage by stage, against brute force; odd rows and an empty table."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.common import crc_mod, spool
from tidemark.llm.language_id import UNDETERMINED, learn

from .test_operators import ODD, PRIVATE, SF, WORDS, base_spans, near_brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHORT = ["The cat sat on the mat.", "Le chat est sur la table.", "Der Hund ist im Garten.", "El perro está en la casa."]


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def redacted(text):
    at, out = 0, ""
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in base_spans(text))):
        if start >= at:
            out += f"{text[at:start]}[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pii, "learn", lambda docs: None)  # spans of the rules only, which brute force can find
    real = rows_of(spark.read.parquet(f"{SF}/documents.parquet"))
    odd = [(10_000 + k, t, None, None, None) for k, t in enumerate([*ODD, *PRIVATE])] + [(30_000 + k, t, None, "short", len(t)) for k, t in enumerate(SHORT)]
    again = [(None, real[0][1], "en", None, 1), (None, real[0][1], "en", None, 1), (None, None, None, None, None), real[3], real[3], (40_000, real[5][1], "en", "copy", 1)]
    spark.createDataFrame(real + odd + again, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    model = learn(docs, crc_mod(F.col("doc_id"), 3) != 1)
    want = [r for r in rows_of(docs) for lang, score in (model.predict(r[1]),) if lang != UNDETERMINED and score >= corpus_pipeline.LEAST_SCORE]
    assert {r[1] for r in want} >= set(SHORT) and {r[0] for r in real} <= {r[0] for r in want} | {r[0] for r in real if not any(map(str.isalpha, r[1] or ""))}
    steps = dict(corpus_pipeline.STAGES)
    got = spool(steps["language_id"](spark, docs, str(tmp_path)))
    assert Counter(rows_of(got)) == Counter(want)

    brute = near_brute([(k, r[1]) for k, r in enumerate(want)], 5, 80)
    groups = {}
    for k, (_, _, root, _) in enumerate(brute):
        groups.setdefault(root, []).append(want[k])
    want = [min(rows, key=lambda r: (r[0] is None, r[0] or 0)) for rows in groups.values()]
    assert not any(r[0] is None for r in want) and {40_000} & {r[0] for r in want} == set() and max(Counter(r[0] for r in want).values()) == 1
    got = spool(steps["minhash_near_dedup"](spark, got, str(tmp_path)))
    assert Counter(rows_of(got)) == Counter(want)

    want = [(i, redacted(t), lang, source, len(redacted(t))) for i, t, lang, source, _ in want]
    assert any("[EMAIL]" in r[1] for r in want)
    got = spool(steps["pii"](spark, got, str(tmp_path)))
    assert Counter(rows_of(got)) == Counter(want)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    pieces = Counter()
    for i, t, *_ in want:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            pieces[i, at // 2048, at, len(part), zlib.crc32(array("I", part).tobytes())] += 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in packed) == pieces
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_whatever_their_names(spark, tmp_path):
    text = SHORT[0] + " It was a long day, and all of them were tired of it. x@y.org"
    rows = [(1, text, "en", "s", 5, 7.0, "zz", 3, "dot"), (1, text, "en", "s", 5, 7.0, "zz", 3, "dot"), (1, SHORT[1] + " Il fait beau dans la ville.", "fr", "s", 5, 7.0, "zz", 3, "dot"), (None, text, "en", "s", 5, 7.0, "zz", 3, "dot"), (None, SHORT[2], "de", "s", 5, 7.0, "zz", 3, "dot")]
    docs = spark.createDataFrame(rows, SCHEMA + ", score double, lang_pred string, row int, `a.b` string")
    steps = dict(corpus_pipeline.STAGES)
    got = steps["minhash_near_dedup"](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter([(1, text), rows[2][:2], rows[4][:2]])
    for name in ("language_id", "pii"):
        got = steps[name](spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert {(r["score"], r["lang_pred"], r["row"], r["a.b"]) for r in got.collect()} <= {(7.0, "zz", 3, "dot")}
