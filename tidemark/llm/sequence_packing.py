"""Order-preserving packing by dynamic programming (operator 13).

A task's documents, in the order in which it reads them, are one stream of token ids, each document closed by one end id.
Windows of at most `capacity` ids are cut from the stream; a window is padded to the capacity unless its length is a power
of two. Cuts may lie at the end of a document, of a sentence, or, at a higher price, inside a long sentence, and those are
chosen for which padding plus the prices of the cuts is least.

    cost[i] = price[i] + min over cuts j before i within the capacity of cost[j] + padding(i - j)

Padding is capacity - (i - j) but for powers of two, so that the minimum is that of cost[j] + j over a sliding window,
which a monotone queue hands out in constant time, and of one candidate for each power of two.

Documents are cut into pieces only by windows. The streams of BLOCK ids are solved each for itself, so that a task holds
one block whatever the table; near the end of a block every position may be a cut, so that its rest can leave in windows
of powers of two. Nothing is shuffled: sequences are numbered by task.

Edge cases: a null or empty text is one piece of one id (the end id); null or repeated doc_ids are packed like others; an
empty table gives no rows; a text without sentence ends, or of any length, is cut inside (at every STRIDE ids beyond the
last boundary); strings of special tokens in a text are ordinary text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import rows, ship

CAPACITY = 1024
#: The end id of every document.
END = 0
#: Prices of a cut, in ids of padding: at the end of a document, at the end of a sentence, inside a sentence.
AT_DOCUMENT, AT_SENTENCE, INSIDE = 0, 4, 48
#: Inside a sentence, cuts may be so far apart; near the end of a block they may be anywhere.
STRIDE = 128
#: Ids of a stream that is solved at once.
BLOCK = 1 << 19
#: A run of so much white space overflows the stack of tiktoken's pattern engine; such a text goes to the tokenizers library.
LONG_RUN = 10_000
#: Characters that are encoded at once, about, and where such a part may end.
PART, WORD_END = 1 << 20, re.compile(r"\S(?=\s)")
#: How sentences end in ids: one that ends with a mark, before one that begins with white space.
MARKS, SPACES = (b".", b"!", b"?"), (b" ", b"\n", b"\r", b"\t")


def byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the rest from U+0100 on in turn."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library, run by the faster tiktoken.

    That is the same if the ids follow the order of the merges (checked) and the words are split by the usual pattern, as
    use_regex says (checked). Strings of special tokens are ordinary text.
    """

    def __init__(self, model: bytes, pattern: str):
        import tiktoken

        spec = json.loads(model)
        letters, vocab = byte_of(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        split = spec["pre_tokenizer"]
        if any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)) or spec["normalizer"] or split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"]:
            raise ValueError("a plain byte-level vocabulary, with ids in the order of its merges, is needed")
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, x)): k for x, k in vocab.items() if x not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.model, self.library = model, None
        self.ends, self.begins = np.zeros(max(vocab.values()) + 1, bool), np.zeros(max(vocab.values()) + 1, bool)
        for token, k in ranks.items():
            self.ends[k], self.begins[k] = token.endswith(MARKS), token.startswith(SPACES)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids. A long text goes by parts that end before white space, where a word always ends."""
        found, at = [], 0
        while at < len(text):
            cut = WORD_END.search(text, at + PART - 1) if len(text) - at > PART else None
            end = cut.end() if cut else len(text)
            found.append(np.array(self.encode(text[at:end]), np.uint32))
            at = end
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        if len(text) > LONG_RUN and re.search(rf"\s{{{LONG_RUN}}}", text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.model.decode())
                self.library.encode_special_tokens = True
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast(text)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where sentences end, before the end of the text."""
        return np.flatnonzero(self.ends[ids[:-1]] & self.begins[ids[1:]]) + 1


_BUILT: dict[tuple, ByteLevel] = {}


def built(model: bytes, pattern: str) -> ByteLevel:
    key = (hashlib.md5(model).digest(), pattern)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteLevel(model, pattern)
    return _BUILT[key]


def windows(positions: np.ndarray, prices: np.ndarray, capacity: int = CAPACITY) -> list[int]:
    """The cuts of least cost: a subset of positions (ascending, the last is the stream's end, none further than the capacity from the one before or from 0)."""
    at = np.concatenate([[0], positions])
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(len(at))
    free: list[tuple[np.ndarray, np.ndarray]] = []  # (cut, cut before it at the distance of a power of two)
    for p in (1 << k for k in range(capacity.bit_length()) if 1 << k < capacity):
        later = np.flatnonzero(at >= p)
        before = index[at[later] - p]
        free.append((later[before >= 0], before[before >= 0]))
    later, before = (np.concatenate(x) for x in zip(*free, strict=True)) if free else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.argsort(later, kind="stable")
    bounds = np.searchsorted(later[order], np.arange(len(at) + 1)).tolist()
    before = before[order].tolist()

    at = at.tolist()
    cost, back = [0], [-1]
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (cost + position, position, index), rising from the front, within the capacity
    for i, price in enumerate(prices.tolist(), 1):
        here = at[i]
        while queue[0][1] < here - capacity:
            queue.popleft()
        least, _, origin = queue[0]
        least += capacity - here
        for j in before[bounds[i] : bounds[i + 1]]:
            if cost[j] < least:
                least, origin = cost[j], j
        least += price
        cost.append(least)
        back.append(origin)
        key = least + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, i))
    out, i = [], len(at) - 1
    while i > 0:
        out.append(at[i])
        i = back[i]
    return out[::-1]


def candidates(ends: np.ndarray, sentences: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(positions, prices) of a stream's possible cuts, from the ends of its documents and of sentences within them."""
    total = int(ends[-1])
    bounds = np.union1d(ends, sentences)
    gaps = np.diff(bounds, prepend=0)
    stride = min(STRIDE, capacity)
    long = np.flatnonzero(gaps > stride)
    inner = [np.arange(bounds[k] - gaps[k] + stride, bounds[k], stride) for k in long.tolist()]
    positions = np.unique(np.concatenate([bounds, *inner, np.arange(max(0, total - 2 * capacity) + 1, total + 1)]))
    prices = np.full(len(positions), INSIDE, np.int64)
    prices[np.searchsorted(positions, sentences)] = AT_SENTENCE
    prices[np.searchsorted(positions, ends)] = AT_DOCUMENT
    return positions, prices


def pack_in_order(docs: DataFrame, model_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every piece in its sequence."""
    vocab = ship(docs.sparkSession, model_path)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def cut(batches):
        codec, first = built(vocab.value, pattern), TaskContext.get().partitionId() << 40
        ids, sizes, names_of, sentences, held = array("I"), [], [], [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in rows(batch):
                own = codec.ids(text or "")
                sentences.append(codec.sentence_ends(own) + held)
                ids.frombytes(own.tobytes())
                ids.append(END)
                names_of.append(doc_id)
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if held >= BLOCK:
                    yield placed(ids, sizes, pa.array(names_of, kind), sentences, first)
                    first += held  # more than there can be sequences in the block
                    ids, sizes, names_of, sentences, held = array("I"), [], [], [], 0
        if held:
            yield placed(ids, sizes, pa.array(names_of, kind), sentences, first)

    def placed(ids, sizes, doc_ids, sentences, first_sequence):
        ends = np.cumsum(np.array(sizes, np.int64))
        begins = ends - sizes
        cuts = np.array(windows(*candidates(ends, np.concatenate(sentences), capacity), capacity), np.int64)
        until = np.union1d(cuts, ends)  # where pieces end
        since = np.concatenate([[0], until[:-1]])
        doc, window = np.searchsorted(ends, until), np.searchsorted(cuts, until)
        whole = memoryview(ids).cast("B")
        crc = np.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(since.tolist(), until.tolist(), strict=True)], np.int64)
        columns = since - begins[doc], until - since, crc, np.array(sizes, np.int64)[doc], first_sequence + window, since - np.concatenate([[0], cuts[:-1]])[window]
        return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(doc)), *map(pa.array, columns)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
