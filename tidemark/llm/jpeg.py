"""Media columns: progressive JPEG (operator 9).

Decoding accumulates spectral-selection and successive-approximation scans into coefficient arrays, inverse-transforms
them in numpy, upsamples chroma and gives a full-resolution RGB tensor. Lossless samples of this format are its quantised
coefficients: a payload byte is stored as one coefficient, 64 bytes as one 8x8 block, in the order luma, blue, red of a
4:2:0 frame with unit quantisers.

A byte b becomes the coefficient of size category 8 whose amplitude bits are b itself (b from 128, else b - 255). Where
a Huffman table holds a single symbol, as here for AC scans, all code words have one width, and the decoder turns
such a scan into a reshape; any other scan is decoded symbol by symbol.

Edge cases: a null or empty text is 64 zero bytes; equal texts give equal stored bytes and features; a text of any
length is one frame (the frame's sides are at most 65,520).
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import rows

#: Fixed values of the format: place in the block of each coefficient in zigzag order, by walking the diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
#: Samples or coefficients that are transformed at a time.
STRIP = 1 << 20
#: Bytes of media and tensors after which rows are handed on.
HELD = 1 << 25
RESTART = re.compile(rb"\xff[\xd0-\xd7]")
SIDE = 4095  # MCUs of 16 samples
FIRST_BITS = 1  # the first scans leave out so many low bits; refinement scans add them


def _basis() -> np.ndarray:
    """Inverse transform as a matrix over coefficients in zigzag order, in whole 2**-14; sums stay exact in doubles."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.round(np.kron(one, one)[:, ZIGZAG] * 2.0**14)


BASIS = _basis()


@dataclass
class Component:
    number: int
    h: int
    v: int
    quantiser: int
    across: int = 0  # blocks of a non-interleaved scan
    down: int = 0
    wide: int = 0  # blocks with those that fill the last MCUs
    high: int = 0
    coefficients: np.ndarray = field(default=None)


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


# ---------------------------------------------------------------- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(bits_or_bytes: np.ndarray) -> bytes:
    return bits_or_bytes.tobytes().replace(b"\xff", b"\xff\x00")


def _pack_words(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Code words of up to 16 bits, most significant bit first; the last byte is filled with ones."""
    ends = np.cumsum(widths)
    total = int(ends[-1]) if len(ends) else 0
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    for b in range(16):
        k = np.flatnonzero(widths > b)
        bits[ends[k] - 1 - b] = values[k] >> b & 1
    return _stuffed(np.packbits(bits))


def _scan(header: list[tuple[int, int]], start: int, end: int, high: int, low: int, data: bytes) -> bytes:
    body = bytes([len(header)]) + b"".join(bytes(x) for x in header) + bytes([start, end, high << 4 | low])
    return _segment(0xDA, body) + data


def _table(kind: int, slot: int, by_length: dict[int, list[int]]) -> bytes:
    return _segment(0xC4, bytes([kind << 4 | slot]) + bytes(len(by_length.get(n, ())) for n in range(1, 17)) + b"".join(bytes(by_length[n]) for n in sorted(by_length)))


#: The DC table has all sizes at four bits; the AC tables one symbol each: a coefficient of size 7, the end of a block.
_TABLES = _table(0, 0, {4: list(range(12))}) + _table(1, 0, {1: [8 - FIRST_BITS]}) + _table(1, 1, {1: [0]})
_QUANTISERS = _segment(0xDB, bytes([0]) + bytes([1]) * 64)
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))


def store(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // 64
    units = -(-n // 6)
    across = -(-units // SIDE)
    down = -(-units // across)
    units = across * down
    blocks = np.full((6 * units, 64), 128, np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    planes = blocks[: 4 * units], blocks[4 * units : 5 * units], blocks[5 * units :]
    frame = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in _SAMPLING)
    dc = np.concatenate([planes[0][:, 0].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(units, 4), planes[1][:, :1], planes[2][:, :1]], 1).astype(np.int16)
    dc = np.where(dc >= 128, dc, dc - 255)
    first = dc >> FIRST_BITS
    diff = first.copy()  # each component's differences from its block before, in MCU order
    luma = np.diff(first[:, :4].ravel(), prepend=np.int16(0)).reshape(units, 4)
    diff[:, :4], diff[:, 4], diff[:, 5] = luma, np.diff(first[:, 4], prepend=np.int16(0)), np.diff(first[:, 5], prepend=np.int16(0))
    diff = diff.ravel().astype(np.int64)
    size = np.frexp(np.abs(diff).astype(float))[1]
    amplitude = np.where(diff < 0, diff + (1 << size) - 1, diff)
    everyone = [(c, 0) for c, *_ in _SAMPLING]
    out = [b"\xff\xd8", _segment(0xFE, b"payload-blocks=%d" % n), _QUANTISERS, _segment(0xC2, frame), _TABLES]
    out.append(_scan(everyone, 0, 0, 0, FIRST_BITS, _pack_words(size << size | amplitude, size + 4)))
    for start, end in ((1, 5), (6, 63)):
        for (c, *_), plane in zip(_SAMPLING, planes, strict=True):  # code word 0, then 7 bits: one byte a coefficient
            out.append(_scan([(c, 0)], start, end, 0, FIRST_BITS, (plane[:, start : end + 1] >> FIRST_BITS).tobytes()))
    out.append(_scan(everyone, 0, 0, FIRST_BITS, 0, _stuffed(np.packbits(np.concatenate([(dc & 1).ravel(), np.ones(-dc.size % 8, np.int16)]).astype(np.uint8)))))
    for (c, *_), plane in zip(_SAMPLING, planes, strict=True):  # the end of the block, then a correction bit for each
        bits = (plane ^ (plane < 128)) & 1
        bits[:, 0] = 0
        out.append(_scan([(c, 1)], 1, 63, FIRST_BITS, 0, _stuffed(np.packbits(bits.ravel()))))
    return b"".join([*out, b"\xff\xd9"])


# ---------------------------------------------------------------- reading


class _Huffman:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.codes: dict[str, int] = {}
        code = k = 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                self.codes[f"{code:0{n}b}"] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.widest = max(map(len, self.codes), default=0)
        self.only = next(iter(self.codes.items())) if len(self.codes) == 1 else None

    def symbol(self, bits: str, at: int) -> tuple[int, int]:
        for n in range(1, self.widest + 1):
            if (found := self.codes.get(bits[at : at + n])) is not None:
                return found, at + n
        raise ValueError("no such code word")


def _bits(data: bytes) -> str:
    return (np.unpackbits(np.frombuffer(data, np.uint8)) + 48).tobytes().decode()


def _signed(bits: str, at: int, size: int) -> int:
    v = int(bits[at : at + size], 2)
    return v if v >> size - 1 else v - (1 << size) + 1


def _dc_scan(parts: list[bytes], order: list[tuple[int, np.ndarray]], tables: list[_Huffman], high: int, low: int, interval: int) -> None:
    """order: for each block of an MCU (component's index, its DC values by MCU)."""
    mcus = len(order[0][1])
    step = interval or mcus
    for part, first in zip(parts, range(0, mcus, step), strict=False):
        last = min(mcus, first + step)
        if high:
            got = np.unpackbits(np.frombuffer(part, np.uint8), count=(last - first) * len(order)).reshape(last - first, len(order))
            for k, (_, values) in enumerate(order):
                values[first:last] |= got[:, k].astype(np.int32) << low
            continue
        bits, at, before, found = _bits(part), 0, {}, []
        each = [(c, tables[c]) for c, _ in order]
        for _ in range(first, last):
            for c, table in each:
                size, at = table.symbol(bits, at) if len(table.codes) != 12 or table.widest != 4 else (table.codes[bits[at : at + 4]], at + 4)
                d = before.get(c, 0)
                if size:
                    d += _signed(bits, at, size)
                    at += size
                before[c] = d
                found.append(d)
        got = np.array(found, np.int32).reshape(last - first, len(order)) << low
        for k, (_, values) in enumerate(order):
            values[first:last] = got[:, k]


def _ac_first(part: bytes, block: np.ndarray, table: _Huffman, start: int, end: int, low: int) -> None:
    n, band = len(block), end - start + 1
    if table.only and 0 < table.only[1] < 16 and len(table.only[0]) + table.only[1] == 8 and len(part) == n * band:
        size = table.only[1]
        for at in range(0, n, STRIP // 64):
            words = np.frombuffer(part, np.uint8).reshape(n, band)[at : at + STRIP // 64].astype(np.int32)
            if (words >> size).any():
                raise ValueError("no such code word")
            block[at : at + STRIP // 64, start : end + 1] = np.where(words >> size - 1, words, words - (1 << size) + 1) << low
        # a negative value's magnitude is shifted, as the first scan divides towards zero
        return
    bits, at, run = _bits(part), 0, 0
    for b in block:
        if run:
            run -= 1
            continue
        k = start
        while k <= end:
            s, at = table.symbol(bits, at)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                b[k] = _signed(bits, at, size) * (1 << low)
                at += size
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) - 1
                if zeros:
                    run += int(bits[at : at + zeros], 2)
                    at += zeros
                break


def _ac_refine(part: bytes, block: np.ndarray, table: _Huffman, start: int, end: int, low: int) -> None:
    n, band, one = len(block), end - start + 1, 1 << low
    part_of = block[:, start : end + 1]
    if table.only and table.only[1] == 0 and len(table.only[0]) + band == 64 and len(part) == 8 * n and part_of.all():
        for at in range(0, n, STRIP // 64):
            got = np.unpackbits(np.frombuffer(part, np.uint8)[8 * at : 8 * at + STRIP // 8]).reshape(-1, 64)[:, 64 - band :]
            some = part_of[at : at + STRIP // 64]
            some += np.sign(some) * (got.astype(np.int32) << low)
        return
    bits, at, run = _bits(part), 0, 0

    def correct(b, k):
        nonlocal at
        if bits[at] == "1":
            b[k] += one if b[k] > 0 else -one
        at += 1

    for b in block:
        k = start
        if not run:
            while k <= end:
                s, at = table.symbol(bits, at)
                zeros, size, value = s >> 4, s & 15, 0
                if size:
                    value = one if bits[at] == "1" else -one
                    at += 1
                elif zeros < 15:
                    run = 1 << zeros
                    if zeros:
                        run += int(bits[at : at + zeros], 2)
                        at += zeros
                    break
                while k <= end:
                    if b[k]:
                        correct(b, k)
                    elif zeros:
                        zeros -= 1
                    else:
                        if value:
                            b[k] = value
                        k += 1
                        break
                    k += 1
        if run:
            for j in range(k, end + 1):
                if b[j]:
                    correct(b, j)
            run -= 1


def decode(data: bytes) -> Frame:
    """The coefficient arrays (blocks by raster, zigzag order) of a progressive JPEG, accumulated over its scans."""
    frame, tables, interval, at = Frame(), {}, 0, 2
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return frame
        length = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xFE:
            frame.comment = body
        elif marker == 0xDB:
            while body:
                wide, slot = body[0] >> 4, body[0] & 15
                frame.quantisers[slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            _, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            frame.components = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_h, most_v = max(c.h for c in frame.components), max(c.v for c in frame.components)
            mcus_x, mcus_y = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
            for c in frame.components:
                c.across, c.down = -(-frame.width * c.h // (8 * most_h)), -(-frame.height * c.v // (8 * most_v))
                c.wide, c.high = mcus_x * c.h, mcus_y * c.v
                c.coefficients = np.zeros((c.high, c.wide, 64), np.int32)
        elif marker == 0xDA:
            end_at = MARKER.search(data, at).start()
            raw, at = data[at:end_at], end_at
            parts = [x.replace(b"\xff\x00", b"\xff") for x in (RESTART.split(raw) if interval else [raw])]
            by = {c.number: c for c in frame.components}
            own = [(by[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
            start, end, approx = body[-3:]
            high, low = approx >> 4, approx & 15
            if start == 0:
                order, scan_tables, views = [], [], []
                for k, (c, slots) in enumerate(own):
                    dc = c.coefficients[:, :, 0]
                    if len(own) == 1:
                        dc = dc[: c.down, : c.across].reshape(-1, 1, 1)
                    else:
                        dc = dc.reshape(c.high // c.v, c.v, c.wide // c.h, c.h).transpose(0, 2, 1, 3).reshape(-1, c.v, c.h)
                    values = [dc[:, y, x].copy() for y in range(dc.shape[1]) for x in range(dc.shape[2])]
                    order += [(k, v) for v in values]
                    scan_tables.append(tables.get((0, slots >> 4)))
                    views.append((c, values))
                _dc_scan(parts, order, scan_tables, high, low, interval)
                for c, values in views:
                    if len(own) == 1:
                        c.coefficients[: c.down, : c.across, 0] = values[0].reshape(c.down, c.across)
                    else:
                        c.coefficients[:, :, 0] = np.stack(values, 1).reshape(c.high // c.v, c.wide // c.h, c.v, c.h).transpose(0, 2, 1, 3).reshape(c.high, c.wide)
            else:
                (c, slots), read_ac = own[0], _ac_refine if high else _ac_first
                block = c.coefficients[: c.down, : c.across].reshape(-1, 64)
                step = interval or len(block)
                for part, first in zip(parts, range(0, len(block), step), strict=False):
                    read_ac(part, block[first : first + step], tables[1, slots & 15], start, end, low)
                c.coefficients[: c.down, : c.across] = block.reshape(c.down, c.across, 64)
        # other segments (APPn) hold nothing that decoding needs


def rgb(frame: Frame) -> np.ndarray:
    """The frame as an RGB tensor (height, width, 3) of bytes: inverse transform, chroma upsampling, colours.

    Done by strips of rows of blocks, so that only the tensor grows with the frame.
    """
    most_h, most_v = max(c.h for c in frame.components), max(c.v for c in frame.components)
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    step = max(1, STRIP // (8 * most_v * frame.width))
    for first in range(0, -(-frame.height // (8 * most_v)), step):
        part = out[8 * most_v * first : 8 * most_v * (first + step)]
        planes = []
        for c in frame.components:
            own = c.coefficients[c.v * first : c.v * (first + step)]
            flat = (own * frame.quantisers[c.quantiser]).reshape(-1, 64).astype(float)
            samples = np.clip(np.floor(flat @ BASIS.T * 2.0**-14 + 128.5), 0, 255).astype(np.int32)
            plane = samples.reshape(len(own), c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(8 * len(own), 8 * c.wide)
            planes.append(plane.repeat(most_v // c.v, 0).repeat(most_h // c.h, 1)[: len(part), : frame.width])
        if len(planes) == 1:
            part[:] = planes[0][:, :, None]
            continue
        y, blue, red = planes[0] << 16, planes[1] - 128, planes[2] - 128  # fixed values: the format's colour weights times 65,536
        part[:, :, 0] = np.clip((y + 91881 * red + 32768) >> 16, 0, 255)
        part[:, :, 1] = np.clip((y - 22554 * blue - 46802 * red + 32768) >> 16, 0, 255)
        part[:, :, 2] = np.clip((y + 116130 * blue + 32768) >> 16, 0, 255)
    return out


def payload_of(frame: Frame) -> bytes:
    """The stored payload, from the coefficients."""
    n = int(frame.comment.removeprefix(b"payload-blocks="))
    parts = []
    for c in frame.components:
        for row in range(0, c.high, step := max(1, STRIP // (64 * c.wide))):
            part = c.coefficients[row : row + step]
            parts.append(np.where(part < 0, part + 255, part).astype(np.uint8).tobytes())
    return b"".join(parts)[: 64 * n]


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel in hundredths (rounded down), and the tensor's digest."""
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (tensor.shape[0] * tensor.shape[1])
    return f"{tensor.shape[1]}x{tensor.shape[0]};rgb={','.join(map(str, means.tolist()))};sha1={hashlib.sha1(tensor).hexdigest()}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))


def media_column(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Digests of each row's stored media; with keep also media, and rgb with its height and width."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media", "rgb", "height", "width"] * keep
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.binary(), pa.int32(), pa.int32()] * keep

    def made(out, id_type):
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *kinds], strict=True)], names=names)

    def run(batches):
        for batch in batches:
            id_type, out, held = batch.schema.field(0).type, [], 0
            for doc_id, text in rows(batch):
                n, payload = padded(text)
                media = store(payload)
                frame = decode(media)
                back, tensor = payload_of(frame), rgb(frame)
                row = (doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor))
                out.append((*row, media, tensor.tobytes(), *tensor.shape[:2]) if keep else row)
                held += (len(media) + tensor.nbytes) * keep
                if len(out) == 256 or held > HELD:
                    yield made(out, id_type)
                    out, held = [], 0
            yield made(out, id_type)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, rgb binary, height int, width int" * keep
    return docs.select("doc_id", "text").mapInArrow(run, schema)
