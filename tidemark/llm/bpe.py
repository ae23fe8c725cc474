"""Byte-level BPE encoding and decoding (operator 1).

Merging one pre-token uses a rank queue: each merge rank owns a bucket of linked-list positions, a two-level bitmap
marks the ranks whose bucket is not empty, and find-first-set on the bitmap gives the lowest pending rank. Entries whose
pair has changed since they were queued are stale and skipped. Work is O(n log n) in the pre-token's bytes, so that one
run of a million letters is no special case.

Edge cases: a null text is the empty text (no ids, hash of no bytes); a null doc_id is passed through; repeated rows
give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import rows, ship

#: Ranks a bitmap word covers, as a power of two.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1
BIT = [1 << b for b in range(1 << WORD_BITS)]
#: Entries of each cache of pre-tokens in a Python worker; when full it starts anew.
CACHE = 700_000
#: Longer strings are encoded each time instead of being cached.
CACHED_CHARS = 64
#: White space other than blank and line feed: texts with it take the pattern's path.
OTHER_SPACE = re.compile(r"[^\S \n]")


class _Cache(dict):
    """ids (packed little-endian uint32) by string, computed when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


class Bpe:
    """Encoder and decoder for a tiktoken rank file and a splitting pattern, without special tokens."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.table = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.words = [0] * ((max(self.table, default=0) >> WORD_BITS) + 1)  # all zero again after each pre-token
        self.pieces = _Cache(self._piece)
        self.spaced = _Cache(self._after_blank)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue is kept in local names: it is the innermost loop of the operator."""
        get, n = self.ranks.get, len(piece)
        if (whole := get(piece)) is not None:
            return [whole]
        after, before, pair = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n
        words, buckets, top, i, j = self.words, {}, 0, -1, -1
        fresh = [(i, r) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        while True:
            for i, r in fresh:  # queue pairs: mark the rank, add the position to its bucket
                pair[i] = r
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    w = r >> WORD_BITS
                    words[w] |= BIT[r & WORD_MASK]
                    top |= 1 << w
            while top:  # find the first set bit: the lowest rank; its leftmost position
                w = (top & -top).bit_length() - 1
                low = words[w] & -words[w]
                rank = (w << WORD_BITS) + low.bit_length() - 1
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    words[w] ^= low
                    if not words[w]:
                        top ^= 1 << w
                if pair[i] == rank:
                    break
            else:
                break
            j = after[i]
            end = after[i] = after[j]
            pair[i] = pair[j] = -1
            fresh = []
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    fresh.append((i, r))
            if (p := before[i]) >= 0:
                if (r := get(piece[p:end])) is None:
                    pair[p] = -1
                else:
                    fresh.append((p, r))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def _piece(self, piece: str) -> bytes:
        return array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _after_blank(self, chunk: str) -> bytes:
        return self._by_pattern(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Ids as packed little-endian uint32.

        A single blank between two non-space characters always starts a pre-token, so texts are cut there and the
        parts looked up; texts where a blank touches other white space go through the pattern as a whole.
        """
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
            return self._by_pattern(text)
        first, *rest = text.split(" ")
        return self._by_pattern(first) + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """Bytes of packed ids."""
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I")))


_BUILT: dict[tuple, Bpe] = {}


def built(ranks: bytes, pattern: str) -> Bpe:
    """One codec for each worker process."""
    key = (hashlib.md5(ranks).digest(), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Bpe(ranks, pattern)
    return _BUILT[key]


def bpe_codec(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and with keep_ids the packed ids) of each row's whole text."""
    vocab = ship(docs.sparkSession, ranks_path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        codec = built(vocab.value, pattern)
        for batch in batches:
            out = []
            for doc_id, text in rows(batch):
                ids = codec.encode(text or "")
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest())
                out.append((*row, ids) if keep_ids else row)
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def token_lengths(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """n_tokens of each row's whole text, aggregated in the task: (n_tokens, n_docs) partial counts."""
    vocab = ship(docs.sparkSession, ranks_path)

    def count(batches):
        codec = built(vocab.value, pattern)
        for batch in batches:
            seen: dict[int, int] = {}
            for (text,) in rows(batch):
                n = len(codec.encode(text or "")) // 4
                seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(count, "n_tokens long, n_docs long")
