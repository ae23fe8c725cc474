"""Best-fit packing with swap-based local search (operator 5).

Documents are encoded, closed by one end id and cut into pieces of at most `capacity` ids. Only the histogram of piece
lengths (at most `capacity` rows, whatever the corpus) goes to the driver. There, best fit decreasing packs lengths as
patterns with multiplicities, then a local search exchanges one piece for one, two for one, or moves a piece between
underfull bins whenever the sum of squared fills rises, until bins run empty. The result is a bounded table of slots;
each piece finds its slot by its rank among the pieces of its length, which comes from per-task counts and one prefix
sum over them, so that no length's pieces ever meet in one task.

Edge cases: a null or empty text is one piece of one id (the end id); null or repeated doc_ids are packed like others;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import os
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, ship, spool

CAPACITY = 2048
#: Words a Python worker remembers. When full, and at the end of a task, it keeps those that it met first: frequent words come early.
CACHE, KEPT_IN_TASK, KEPT_BETWEEN_TASKS = 500_000, 200_000, 80_000
CACHED_BYTES = 48
#: The end id of every document.
END = 0


class WordTokenizer(dict):
    """Packed ids by white-space separated lower-case word, from a tokenizer that drops white space and ignores case.

    Such a tokenizer never looks across white space, so a text's ids are its words' ids in turn; words repeat, and
    each is encoded by the library once.
    """

    def __init__(self, model: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 1 and word[-1] in b".,!?:;" and (chr(word[-2]).isascii() and chr(word[-2]).isalnum()):
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = array("I", self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE:
                self.trim(KEPT_IN_TASK)
            self[word] = ids
        return ids

    def trim(self, most: int) -> None:
        if len(self) > most:
            kept = list(islice(self.items(), most))
            self.clear()
            self.update(kept)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode("utf-8", "replace").lower().split()))


_BUILT: dict[bytes, WordTokenizer] = {}


def built(model: bytes) -> WordTokenizer:
    key = hashlib.md5(model).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = WordTokenizer(model)
    return _BUILT[key]


def pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (task, rank): the piece's number among its task's of that length."""
    vocab = ship(docs.sparkSession, model_path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]

    def cut(batches):
        tokenizer, task, seen = built(vocab.value), TaskContext.get().partitionId(), {}
        end = array("I", [END]).tobytes()
        for batch in batches:
            out = []
            for doc_id, text in rows(batch):
                ids = tokenizer.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rank = seen[n] = seen.get(n, -1) + 1
                    out.append((doc_id, k, at // 4, n, zlib.crc32(part), task, rank))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
        tokenizer.trim(KEPT_BETWEEN_TASKS)  # idle workers stay, and later stages need the memory

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, rank long")


class Bins:
    """Groups of equal bins: pattern (lengths, descending) -> number of bins."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: dict[tuple[int, ...], int] = {}

    def add(self, pattern: tuple[int, ...], count: int) -> None:
        if count and pattern:
            self.groups[pattern] = self.groups.get(pattern, 0) + count

    def take(self, pattern: tuple[int, ...], count: int) -> None:
        left = self.groups[pattern] - count
        if left:
            self.groups[pattern] = left
        else:
            del self.groups[pattern]

    def count(self) -> int:
        return sum(self.groups.values())


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Best fit decreasing over lengths with multiplicities."""
    bins = Bins(capacity)
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if room not in open_by_room:
            open_by_room[room] = {}
            bisect.insort(rooms, room)
        open_by_room[room][pattern] = open_by_room[room].get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length  # a new bin is then the best fit for the next copies, until it is full
                if left >= each:
                    put(capacity - each * length, (length,) * each, left // each)
                    left %= each
                else:
                    put(capacity - left * length, (length,) * left, 1)
                    left = 0
                continue
            room = rooms[k]
            pattern, count = next(iter(open_by_room[room].items()))
            each = min(room // length, left)
            n = min(count, left // each)
            if n == count:
                del open_by_room[room][pattern]
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(k)
            else:
                open_by_room[room][pattern] = count - n
            put(room - each * length, pattern + (length,) * each, n)
            left -= n * each
    for by in open_by_room.values():
        for pattern, count in by.items():
            bins.add(tuple(sorted(pattern, reverse=True)), count)
    return bins


def _without(pattern: tuple[int, ...], *parts: int) -> tuple[int, ...]:
    out = list(pattern)
    for x in parts:
        out.remove(x)
    return tuple(out)


def _sums(pattern: tuple[int, ...]) -> int:
    """Bit set of what a bin can give at once: one length, or two."""
    bits = 0
    for k, y in enumerate(pattern):
        if k and pattern[k - 1] == y:
            continue
        bits |= 1 << y
        for z in set(pattern[k + 1 :]):
            bits |= 1 << y + z
    return bits


def _parts(pattern: tuple[int, ...], total: int) -> tuple[int, ...]:
    """One or two lengths of the pattern that make up total."""
    if total in pattern:
        return (total,)
    for k, y in enumerate(pattern):
        if total - y in pattern[k + 1 :]:
            return y, total - y
    raise ValueError(total)


class Underfull:
    """Underfull groups by fill; over the fills a binary tree of the sums that bins can give.

    A fill's sums may be too many after a group has gone; they are made anew when a sum isn't found there.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.at: dict[int, dict[tuple[int, ...], int]] = {}

    def add(self, pattern: tuple[int, ...]) -> None:
        fill, bits = sum(pattern), _sums(pattern)
        self.at.setdefault(fill, {})[pattern] = bits
        k = fill + self.size
        while k and self.tree[k] | bits != self.tree[k]:
            self.tree[k] |= bits
            k >>= 1

    def remove(self, pattern: tuple[int, ...]) -> None:
        fill = sum(pattern)
        del self.at[fill][pattern]
        if not self.at[fill]:
            self.renew(fill)

    def renew(self, fill: int) -> None:
        bits = 0
        for x in self.at[fill].values():
            bits |= x
        k = fill + self.size
        while self.tree[k] != bits:
            self.tree[k] = bits
            k >>= 1
            if not k:
                break
            bits = self.tree[2 * k] | self.tree[2 * k + 1]

    def sums(self, most: int) -> int:
        """Of all bins filled to `most` or less."""
        bits, k = 0, most + self.size
        bits = self.tree[k]
        while k > 1:
            if k & 1:
                bits |= self.tree[k - 1]
            k >>= 1
        return bits

    def giver(self, total: int, most: int, but: tuple[int, ...] | None) -> tuple[int, ...] | None:
        """The least filled group, up to `most` and other than `but`, that can give total."""
        bit = 1 << total
        while True:
            k = 1
            if not self.tree[k] & bit:
                return None
            while k < self.size:
                k = 2 * k if self.tree[2 * k] & bit else 2 * k + 1
            fill = k - self.size
            if fill > most:
                return None
            own = False
            for pattern, bits in self.at[fill].items():
                if bits & bit:
                    if pattern != but:
                        return pattern
                    own = True
            if own:  # no other at this fill; `but` is as full as `most`, so that fuller ones don't count
                return None
            self.renew(fill)


def _change(pattern: tuple[int, ...], count: int, under: Underfull, capacity: int):
    """(giver, what leaves the bin, what comes in) of the change that fills the bin most; None if none fills it."""
    fill = sum(pattern)
    room, best, found = capacity - fill, 0, None
    but = pattern if count < 2 else None
    bits = under.sums(fill)
    for x in (0, *sorted(set(pattern))):
        while True:
            d = (bits >> x + 1 & (1 << room) - 1).bit_length()  # the largest sum in x+1 .. x+room, less x
            if d <= best:
                break
            giver = under.giver(x + d, fill, but)
            if giver is not None:
                best, found = d, (giver, (x,) if x else (), _parts(giver, x + d))
                break
            bits &= ~(1 << x + d)
        if best == room:
            break
    return found


#: Bits of a count that one level of the search looks at first, and that each further level adds.
FIRST_LEVEL, LEVEL = 6, 1


def local_search(bins: Bins) -> Bins:
    """Raise the sum of squared fills until no pair of underfull bins allows it, by levels of the counts (see settled).

    All counts are first divided by a power of two that leaves FIRST_LEVEL bits, and the changes found there are applied so
    many times over. Each further level takes in LEVEL bits more: what earlier levels have settled meets remainders of a few
    bins only. So steps follow the lengths and the number of levels, the logarithm of the largest count, and not the
    counts; the last level leaves no improving pair.
    """
    top = max(bins.groups.values(), default=0).bit_length()
    for shift in [*range(max(0, top - FIRST_LEVEL), 0, -LEVEL), 0]:
        level = Bins(bins.capacity)
        level.groups = {p: n >> shift for p, n in bins.groups.items() if n >> shift}
        rest = {p: n & (1 << shift) - 1 for p, n in bins.groups.items()}
        bins.groups = {p: n << shift for p, n in settled(level).groups.items()}
        for p, n in rest.items():
            bins.add(p, n)
    return bins


def settled(bins: Bins) -> Bins:
    """Raise the sum of squared fills until no pair of underfull bins allows it, the fullest first and from the least filled.

    A change moves one or two pieces of bin b to a fuller-or-equal bin a, for one piece of a or none. Moving weight d
    raises the sum by 2d(fill(a) - fill(b) + d) > 0, so every change is an improvement and the search ends. All bins of a
    group change at once; what a bin lacks is looked up among the sums that others can give, so that only pairs that
    improve are met, and a last pass over all groups finds none.
    """
    capacity = bins.capacity
    under = Underfull(capacity)
    for p in bins.groups:
        if sum(p) < capacity:
            under.add(p)

    def put(pattern: tuple[int, ...], n: int) -> None:
        if pattern and pattern not in bins.groups and sum(pattern) < capacity:
            under.add(pattern)
        bins.add(pattern, n)

    def take(pattern: tuple[int, ...], n: int) -> None:
        bins.take(pattern, n)
        if pattern not in bins.groups:
            under.remove(pattern)

    improved = True
    while improved:
        improved = False
        todo = [(-sum(p), p) for p in bins.groups if sum(p) < capacity]
        heapq.heapify(todo)
        while todo:
            a = heapq.heappop(todo)[1]
            if a not in bins.groups:
                continue
            found = _change(a, bins.groups[a], under, capacity)
            if found is None:
                continue
            b, out, into = found
            n = bins.groups[a] // 2 if a == b else min(bins.groups[a], bins.groups[b])
            take(a, n)
            take(b, n)
            for p in (tuple(sorted((*_without(a, *out), *into), reverse=True)), tuple(sorted((*_without(b, *into), *out), reverse=True))):
                put(p, n)
                if sum(p) < capacity:
                    heapq.heappush(todo, (-sum(p), p))
            if a in bins.groups:
                heapq.heappush(todo, (-sum(a), a))
            improved = True
    return bins


def slots(bins: Bins) -> dict[int, list[tuple[int, int, int]]]:
    """By length: (first rank, first sequence, offset) of each run of slots, by rank. Bins of a group are numbered in turn."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for pattern in sorted(bins.groups, reverse=True):
        count, offset = bins.groups[pattern], 0
        for length in pattern:
            rank = filled.get(length, 0)
            out.setdefault(length, []).append((rank, first, offset))
            filled[length] = rank + count
            offset += length
        first += count
    return out


def pack(docs: DataFrame, model_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece in its sequence."""
    cut = spool(pieces(docs, model_path, capacity))
    counts = spool(cut.groupBy("length", "task").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = slots(local_search(best_fit(histogram, capacity)))
    table = {length: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for length, runs in where.items()}
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut.join(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("before")), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank")
    )

    def place(batches):
        by_length = shipped.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                first, sequences, offsets = by_length[int(length[part[0]])]
                k = np.searchsorted(first, rank[part], side="right") - 1
                sequence[part] = sequences[k] + rank[part] - first[k]
                offset[part] = offsets[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
