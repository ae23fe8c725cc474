"""Operators 11 to 13 against brute force, the library and the given SQL's rules, with their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import expiring_dedup as X
from tidemark.llm import queries
from tidemark.llm import sequence_packing as S
from tidemark.llm import source_audit as A

BYTE_MODEL = P.path("byte_bpe_50k.json")
EPOCH = datetime(1970, 1, 1)

# ---------------------------------------------------------------- 11


def audit_brute(docs, least=30):
    rows = [tuple(x or "" for x in d) for d in docs]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(r[1], w) for r, w in zip(rows, words, strict=True) if r[0] == lang]
        df = Counter(t for _, w in mine for t in set(w))
        kept = sorted((t for t, n in df.items() if n >= least), key=lambda t: t.encode())
        counts = defaultdict(Counter)
        for source, w in mine:
            counts[source].update(t for t in w if df[t] >= least)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q, p = share(whole), {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in counts if o != s))
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:50]
            out += [(lang, s, part, x, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, x) in enumerate(found, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = ["Der", "der", "Ähm", "ähm", "x1y", "naïve", "日本", "a-b", "it's", "\xa0", "É", "rare", *(f"w{chr(97 + k)}" for k in range(20))]
    docs = [(rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["s0", "s0", "s0", "S1", "s2", None, "é", "z"]), " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 30)))) for _ in range(700)]
    docs += [("fr", "a", "too few"), ("fr", "b", None), ("xx", "only", "a " * 50), ("en", "silent", None), ("en", "digits", "12 34 !"), ("en", "long", "Der wa " * 40_000), (None, None, None)]
    docs += docs[:20]
    df = spark.createDataFrame([(*d, k % 7, "clash") for k, d in enumerate(docs)], "lang string, source string, text string, n long, term string")
    got = sorted(tuple(r) for r in A.divergence(df).collect())
    assert got == audit_brute(docs)
    assert {r[1] for r in got if r[0] == "en"} >= {"silent", "digits", ""} and any(r[4] == 0 for r in got if r[0] == "fr")
    assert A.divergence(df.limit(0)).count() == 0


def test_divergence_hands_on_counts_when_its_table_is_full(spark, monkeypatch):
    docs = [("en", f"s{k % 3}", " ".join(f"w{chr(97 + (k * j) % 23)}{chr(97 + j)}" for j in range(12))) for k in range(300)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    whole = sorted(tuple(r) for r in A.divergence(df, least=5).collect())
    monkeypatch.setattr(A, "MOST_COUNTS", 10)
    monkeypatch.setattr(A, "PART", 5)
    assert [w for part in A._words(b"Ab,cd  e-fghij klm 1") for w in part] == [b"ab", b"cd", b"e", b"fghij", b"klm"]
    assert sorted(tuple(r) for r in A.divergence(df, least=5).collect()) == whole == audit_brute(docs, 5)


def test_shares_are_exact_for_huge_counts(spark):
    n, total, kept = 10**13 + 1, 3 * 10**15, 10**8
    got = spark.range(1).select(A._share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * kept)


# ---------------------------------------------------------------- 12


def micros(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def clicks_brute(rows, batches=8):
    copies = []
    for click, ts, arrived, client, kind, value, props in rows:
        if click is None or arrived is None:
            continue
        for j in range(click % 3 + 1 if click >= 0 else (0 if click % -3 else 1)):
            c = zlib.crc32(f"{click}:{j}".encode())
            hour = micros(arrived) // 3_600_000_000 + 6 * j * (c % 10)
            cents = "" if value is None else str(int(np.floor(100 * value + 0.5)))
            text = lambda x: "" if x is None else str(x)
            line = "|".join([text(client), text(kind), cents, text(micros(ts)), text(props), str(c % 3)])
            copies.append((click, hour, hashlib.sha256(line.encode()).hexdigest(), hour + c // 10 % 200))
    if not copies:
        return []
    low, high = min(c[3] for c in copies), max(c[3] for c in copies)
    by = defaultdict(list)
    for click, hour, digest, late in copies:
        by[(late - low) * batches // (high - low + 1)].append((click, hour, digest))
    latest, open_, out = None, {}, []
    for b in range(batches):
        for click, hour, digest in sorted(by[b]):
            if latest is not None and b and hour < latest - 96:
                continue
            w = open_.get(click)
            if w and hour <= w[0] + 24:
                w[2] += 1
                if digest != w[1]:
                    w[3] += 1
                    w[4] += zlib.crc32(digest.encode())
                continue
            if w:
                out.append((click, w[0], b, *w[2:], w[1]))
            open_[click] = [hour, digest, 0, 0, 0]
        latest = max([h for _, h, _ in by[b]] + ([latest] if latest is not None else []), default=None)
        for click, w in list(open_.items()):
            if b == batches - 1 or latest is not None and w[0] + 24 < latest - 96:
                out.append((click, w[0], b, *w[2:], w[1]))
                del open_[click]
    return sorted(out)


SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def made_clicks(seed, n):
    rnd, start = random.Random(seed), datetime(2024, 3, 30)
    rows = []
    for k in range(n):
        at = start + timedelta(hours=rnd.expovariate(1 / 300), microseconds=rnd.randrange(10**6))
        click = rnd.choice([k, k, rnd.randint(0, 20), 5])  # some come again and again
        rows.append((click, None if rnd.random() < 0.05 else at, at, rnd.choice([None, 1, 2]), rnd.choice([None, "a|b", "view"]), rnd.choice([None, 1.005, -3.335, 1e9]), rnd.choice([None, "", '{"é": 1}', "x" * 5000])))
    return rows + rows[:10] + [(None, start, start, 1, "a", 1.0, ""), (7, start, None, 1, "a", 1.0, ""), (-1, start, start, 1, "neg", 1.0, ""), (-3, start, start, 1, "neg", 1.0, "")]


def test_expiring_clicks_equal_a_sequential_fold(spark):
    rows = made_clicks(4, 250)
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", hash string")
    got = sorted(tuple(r) for r in X.expiring_clicks(df).collect())
    assert got == clicks_brute(rows)
    assert any(r[4] for r in got) and len({r[2] for r in got}) > 3 and -3 in {r[0] for r in got} and -1 not in {r[0] for r in got}
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none")  # the caller's session is left as it was


def test_no_clicks_no_windows(spark):
    assert X.expiring_clicks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_bucket_folds_as_rows_in_turn():
    """Windows against plain Python over many batches, with equal events added up and hashes that begin alike."""
    rnd = random.Random(8)
    hashes = [b"\0" * 8 + bytes([k]) * 24 for k in range(3)] + [b"\0" * 32, b"a" * 31 + b"\0"]
    windows, open_, want, got = X.Windows([]), {}, [], []
    for batch in range(12):
        rows = sorted((rnd.randint(0, 12), 40 * batch + rnd.randint(-60, 90), rnd.choice(hashes)) for _ in range(rnd.choice([0, 1, 150])))
        for click, hour, h in rows:
            w = open_.get(click)
            if w and hour <= w[0] + X.SPAN:
                w[2] += 1
                w[3] += h != w[1]
                w[4] += (h != w[1]) * h[8]
                continue
            if w:
                want.append((click, batch, *w))
            open_[click] = [hour, h, 0, 0, 0]
        for click, w in list(open_.items()):
            if w[0] + X.SPAN < 40 * batch - X.HORIZON:
                want.append((click, batch, *w))
                del open_[click]
        if rows:
            click, hour = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
            crc = np.array([r[2][8] for r in rows], np.int64)
            split = len(rows) // 2
            part = lambda s: (click[s], hour[s], X._hashes([r[2] for r in rows[s]]), crc[s], np.ones(len(rows[s]), np.int64))  # noqa: E731, B023
            halves = [X.added_up([part(s)]) for s in (slice(split), slice(split, None)) if len(rows[s])]
            windows.fold(batch, *X.added_up(halves))
        windows.expire(batch, 40 * batch - X.HORIZON)
        gone = windows.closed >= 0
        for k in np.flatnonzero(gone):
            got.append((int(windows.click[k]), int(windows.closed[k]), int(windows.start[k]), windows.hash[k].astype(">u8").tobytes(), *windows.counts[k].tolist()))
        windows = X.Windows([windows.page(np.flatnonzero(~gone))])
    assert sorted(got) == sorted(want) and len(want) > 50


# ---------------------------------------------------------------- 13


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_MODEL)
    t.encode_special_tokens = True
    return t


ODD = ["", None, " ", "a  b", "a   b", "a \n b.\n \nC? d", "é\xa0b. x", "it's <|endoftext|> here.", "don't  stop!  Now", "." * 3000, "y" * 5000, " " * 12_000 + "x", "\n" * 30, "Hi. " * 900, "日本語。です", "a.b.c. D"]


def padding(n, capacity=1024):
    return 0 if n & (n - 1) == 0 else capacity - n


def test_sequences_hold_the_librarys_ids_once(spark):
    rnd, t = random.Random(2), library()
    texts = [*ODD, *(" ".join(rnd.choice(["word", "Längeres", "x.", "done!", "12", "\n\n"]) for _ in range(rnd.randint(1, 3000))) for _ in range(60))]
    docs = [(k if k % 9 else None, x) for k, x in enumerate(texts)] + [(5, texts[5])] * 3
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int").repartition(3)
    got = S.pack_in_order(df, BYTE_MODEL, P.PATTERN).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = Counter()
    for k, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want[k, len(ids)] += 1
        pieces = sorted(set(by[k, len(ids)]))
        assert all(zlib.crc32(array("I", ids[s : s + n]).tobytes()) == crc for s, n, crc in pieces if sum(j == (k, len(ids)) for j in want) == 1) or k is None
    for (k, n), count in want.items():
        assert sum(length for _, length, _ in by[k, n]) == n * count
    lost = sum(padding(sum(n for _, n in parts)) for parts in sequences.values())
    assert lost < 0.05 * sum(r.length for r in got)
    assert S.pack_in_order(df.limit(0), BYTE_MODEL, P.PATTERN).count() == 0


def test_encoding_equals_the_library(monkeypatch):
    codec, t, rnd = S.built(open(BYTE_MODEL, "rb").read(), P.PATTERN), library(), random.Random(1)
    for x in [y for y in ODD if y] + ["".join(rnd.choice("ab.!  \n\t\xa01é'日") for _ in range(rnd.randint(1, 40))) for _ in range(4000)]:
        assert codec.encode(x) == t.encode(x, add_special_tokens=False).ids
    long = " ".join(rnd.choice(["word", "Wörter.", "\n\n", "  x", "1234"]) for _ in range(3000))
    for size in (1, 2, 7, 100, 1 << 20):
        monkeypatch.setattr(S, "PART", size)
        for x in ("", "a", " ", "ab  c", long, "y" * 500):
            assert codec.ids(x).tolist() == t.encode(x, add_special_tokens=False).ids
    with pytest.raises(ValueError):
        S.ByteLevel(open(P.path("word_bpe_49k.json"), "rb").read(), P.PATTERN)


def test_cuts_are_of_least_cost():
    """The monotone queue and the powers of two against all cuts before each."""
    rnd = random.Random(6)
    for capacity in (4, 7, 16, 33):
        for _ in range(60):
            gaps = [rnd.randint(1, capacity) for _ in range(rnd.randint(1, 25))]
            at = np.cumsum(gaps)
            prices = np.array([rnd.choice([0, 2, 9]) for _ in gaps])
            cost = [0]
            for i in range(1, len(at) + 1):
                lengths = [(j, int(at[i - 1] - (at[j - 1] if j else 0))) for j in range(i)]
                cost.append(min(cost[j] + padding(n, capacity) for j, n in lengths if n <= capacity) + int(prices[i - 1]))
            cuts = S.windows(at, prices, capacity)
            own = sum(padding(b - a, capacity) for a, b in zip([0, *cuts], cuts, strict=False)) + sum(int(prices[list(at).index(c)]) for c in cuts)
            assert own == cost[-1] and cuts[-1] == at[-1] and all(b - a <= capacity for a, b in zip([0, *cuts], cuts, strict=False))


def test_candidates_reach_across_long_sentences():
    positions, prices = S.candidates(np.array([5, 5000]), np.array([3, 4000]))
    assert np.diff(positions, prepend=0).max() <= S.STRIDE and dict(zip(positions.tolist(), prices.tolist(), strict=True)) | {3: 4, 5: 0, 4000: 4, 5000: 0, 4999: 48} == dict(zip(positions.tolist(), prices.tolist(), strict=True))


# ---------------------------------------------------------------- all


def test_the_new_queries_return_the_contracts_columns(spark):
    wanted = {
        "op11_source_divergence": [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")],
        "op13_order_packing": [("doc_id", "bigint"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("doc_tokens", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    }
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").dtypes == columns
    assert X.WINDOW == "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
