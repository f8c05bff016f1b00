"""Progressive JPEG columns: scans into coefficient arrays, pixels by an exact inverse transform.

Decoding is array arithmetic over many images: every restart interval of every scan is a lane,
and all lanes of a batch read their next symbol in step. Scans that touch the same coefficients
(successive approximation) are taken one after another; scans over different components or
bands run together. Coefficients become samples by an integer inverse transform, chroma is
repeated to full resolution, and samples become RGB.

A payload of bytes is stored losslessly in the coefficients themselves: 64 bytes a block, in
zigzag order, less 128, with all quantizers 1. Blocks fill the units of a 4:2:0 image in scan
order; a comment names the payload's length. The scans are DC, AC 1-16 and AC 17-63 per
component, with the last bit of DC and AC 1-16 in refining scans. A payload beyond ``PAYLOAD`` bytes
is stored as several images, one after another in the same cell, so that the memory of coding does
not grow with a text.

Defined cases: a null or empty text is a payload of 64 zero bytes; a text of any length is stored
whole; an empty table gives no rows; rows that share an id or have none are stored each on its own;
only the key and the text are read, so other columns may have any names; a damaged or unsupported
stream raises ValueError; equal payloads give equal streams, pixels and features, whatever their
neighbours in a batch.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import text as T

U64 = np.uint64
RESTART, SPLIT = 16, 16  # units an interval; last coefficient of the first AC band
#: Bytes of a payload in one image, and of streams that are decoded at once.
PAYLOAD, DECODED = 2 << 20, 4 << 20
#: Row-major place of each coefficient in zigzag order: along anti-diagonals, turning at each end.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: (components, first and last coefficient, bit position before, bit position now) of each scan of a stored payload.
SCRIPT = [((0, 1, 2), 0, 0, 0, 1)] + [((c,), 1, SPLIT, 0, 1) for c in range(3)] + [((c,), SPLIT + 1, 63, 0, 0) for c in range(3)] + [((0, 1, 2), 0, 0, 1, 0)] + [((c,), 1, SPLIT, 1, 0) for c in range(3)]
SIZE_OF = np.array([int(i).bit_length() for i in range(4096)])


# --- Huffman tables


def _spec(lengths: dict[int, list[int]]) -> tuple[bytes, bytes]:
    """Counts by length and symbols, as a DHT segment holds them."""
    return bytes(len(lengths.get(n, [])) for n in range(1, 17)), bytes(s for n in range(1, 17) for s in lengths.get(n, []))


_COMMON = [0x00, 0xF0, *range(0x01, 0x09), *range(0x11, 0x17)]
DC_SPEC = _spec({4: list(range(12))})
AC_SPEC = _spec({5: _COMMON, 9: [r << 4 | s for r in range(16) for s in range(1, 11) if r << 4 | s not in _COMMON]})


@lru_cache(512)
def codes(spec: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length of each symbol, and for every 16 next bits: length << 8 | symbol (0: no code)."""
    code, length, table = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    now, at = 0, 0
    for n, count in enumerate(spec[0], 1):
        for s in spec[1][at : at + count]:
            code[s], length[s] = now, n
            table[now << (16 - n) : (now + 1) << (16 - n)] = n << 8 | s
            now += 1
        at += count
        now <<= 1
    return code, length, table


# --- geometry


@dataclass
class Component:
    name: int
    h: int
    v: int
    quant: int
    stride: int = 0  # blocks in a row, whole units
    rows: int = 0
    base: int = 0  # first block among the image's
    alone: np.ndarray | None = None  # blocks in the order of a scan over this component only


@dataclass
class Scan:
    parts: list[int]
    first: int
    last: int
    before: int
    now: int
    tables: list
    restart: int
    starts: list[int] = field(default_factory=list)


@dataclass
class Image:
    width: int
    height: int
    parts: list[Component]
    blocks: int
    units: np.ndarray  # blocks in the order of an interleaved scan over all components
    unit_part: np.ndarray
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""


@lru_cache(4096)
def _geometry(width: int, height: int, parts: tuple) -> tuple:
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    out, base, pieces, owner = [], 0, [], []
    row, col = np.divmod(np.arange(across * down), across)
    for i, (name, h, v, quant) in enumerate(parts):
        c = Component(name, h, v, quant, across * h, down * v, base)
        wide, high = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        c.alone = (base + np.arange(high)[:, None] * c.stride + np.arange(wide)).ravel()
        inner = (np.arange(v)[:, None] * c.stride + np.arange(h)).ravel()
        pieces.append(base + (row * v * c.stride + col * h)[:, None] + inner)
        owner.append(np.full((len(row), h * v), i))
        base += c.stride * c.rows
        out.append(c)
    return out, base, np.concatenate(pieces, axis=1).ravel(), np.concatenate(owner, axis=1).ravel()


def _image(width: int, height: int, parts: tuple) -> Image:
    return Image(width, height, *_geometry(width, height, parts))


YCC = ((1, 2, 2, 0), (2, 1, 1, 0), (3, 1, 1, 0))


def _fitting(blocks: int) -> Image:
    """The 4:2:0 image that holds a payload of so many blocks."""
    units = -(-blocks // 6)
    across = min(units, max(64, isqrt(units)))
    down = -(-units // across)
    if max(across, down) > 4095:
        raise ValueError("a payload of over 1.6 GB needs several images")
    return _image(16 * across, 16 * down, YCC)


# --- encoding


def _packed(code: np.ndarray, length: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Codes as bytes: each interval (codes up to ``ends``) is padded with ones and stuffed; byte offsets of intervals."""
    total = np.concatenate([[0], np.cumsum(length)])
    bits = np.diff(total[np.concatenate([[0], ends])])
    size = -(-bits // 8)
    start = np.concatenate([[0], np.cumsum(size)])
    count = np.diff(np.concatenate([[0], ends]))
    at = total[:-1] + np.repeat(start[:-1] * 8 - (np.cumsum(bits) - bits), count)
    pad = size * 8 - bits
    at = np.concatenate([at, start[:-1] * 8 + bits])
    code = np.concatenate([code, (1 << pad) - 1]).astype(U64)
    length = np.concatenate([length, pad])
    field_ = code << (64 - length - (at & 31)).astype(U64) if len(at) else code
    field_ = np.where(length > 0, field_, U64(0))
    words = int(start[-1]) // 4 + 3
    out = np.bincount(at >> 5, (field_ >> U64(32)).astype(np.float64), words) + np.bincount((at >> 5) + 1, (field_ & U64(0xFFFFFFFF)).astype(np.float64), words)
    raw = out.astype(np.uint32).astype(">u4").view(np.uint8)[: start[-1]]
    full = raw == 0xFF
    before = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(len(raw) + before[-1], np.uint8)
    stuffed[np.arange(len(raw)) + before[:-1]] = raw
    return stuffed.tobytes(), start + before[start]


def _signed(v: np.ndarray, mag: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Extra bits of a value: negative ones in complement."""
    return np.where(v < 0, mag ^ ((1 << size) - 1), mag)


def _dc_first(v: np.ndarray, part: np.ndarray, fresh: np.ndarray, low: int):
    """Codes of DC differences; ``fresh`` marks the first block of each interval."""
    v = v >> low
    diff = np.empty_like(v)
    interval = np.cumsum(fresh)
    for p in range(int(part.max(initial=0)) + 1):
        own = np.flatnonzero(part == p)
        x = v[own]
        d = np.diff(x, prepend=0)
        new = np.diff(interval[own], prepend=0) != 0
        d[new] = x[new]
        diff[own] = d
    mag = np.abs(diff)
    size = SIZE_OF[mag]
    code, length, _ = codes(DC_SPEC)
    return code[size] << size | _signed(diff, mag, size), length[size] + size, np.ones(len(v), np.int64)


def _ac_first(v: np.ndarray, low: int):
    """Codes of a band, and their number by block. A block's zeros at its end are one code."""
    n, width = v.shape
    mag = np.abs(v) >> low
    row, col = np.nonzero(mag)
    run = np.empty(len(row), np.int64)
    same = np.concatenate([[False], row[1:] == row[:-1]]) if len(row) else np.zeros(0, bool)
    run[~same] = col[~same]
    run[same] = col[same] - col[np.flatnonzero(same) - 1] - 1
    skip, run = run >> 4, run & 15
    m = mag[row, col]
    size = SIZE_OF[m]
    code, length, _ = codes(AC_SPEC)
    symbol = run << 4 | size
    count = np.zeros((n, width + 1), np.int64)
    count[row, col] = skip + 1
    end = np.flatnonzero(mag[:, -1] == 0)
    count[end, width] = 1
    stop = np.cumsum(count.ravel())
    total = int(stop[-1]) if n else 0
    out, bits = np.full(total, code[0xF0]), np.full(total, length[0xF0])
    at = stop[row * (width + 1) + col] - 1
    out[at], bits[at] = code[symbol] << size | _signed(v[row, col], m, size), length[symbol] + size
    at = stop[end * (width + 1) + width] - 1
    out[at], bits[at] = code[0], length[0]
    return out, bits, count.sum(axis=1)


def _ac_refine(v: np.ndarray, low: int):
    """Codes that add a bit to a band of at most 16 coefficients, so that no run of zeros is over 15."""
    n, width = v.shape
    mag = np.abs(v) >> low
    new, old, zero = mag == 1, mag > 1, mag == 0
    begin = np.zeros((n, width), bool)
    begin[:, 0] = True
    begin[:, 1:] = new[:, :-1]
    upto = np.where(new, np.arange(width), width)
    after = np.minimum.accumulate(upto[:, ::-1], axis=1)[:, ::-1]
    zeros = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(zero, axis=1)], axis=1)
    count = begin.astype(np.int64) + old
    stop = np.cumsum(count.ravel()).reshape(n, width)
    total = int(stop[-1, -1]) if n else 0
    out, bits = np.zeros(total, np.int64), np.ones(total, np.int64)
    code, length, _ = codes(AC_SPEC)
    row, col = np.nonzero(old)
    out[stop[row, col] - 1] = mag[row, col] & 1
    row, col = np.nonzero(begin)
    to = after[row, col]
    ends = to == width
    run = zeros[row, np.minimum(to, width)] - zeros[row, col]
    symbol = np.where(ends, 0, run << 4 | 1)
    positive = v[row, np.minimum(to, width - 1)] > 0
    at = stop[row, col] - count[row, col]
    out[at] = np.where(ends, code[symbol], code[symbol] << 1 | positive)
    bits[at] = length[symbol] + ~ends
    return out, bits, count.sum(axis=1)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def whole(payload: bytes) -> bytes:
    """A payload of any size as one or more images."""
    return b"".join(x for a in range(0, len(payload), PAYLOAD) for x in stored([payload[a : a + PAYLOAD]]))


def single(stream: bytes) -> list[bytes]:
    """The images of a cell. Inside an image, no end marker is followed by a start marker."""
    out, at = [], 0
    while (end := stream.find(b"\xff\xd9\xff\xd8", at)) >= 0:
        out.append(stream[at : end + 2])
        at = end + 2
    return [*out, stream[at:]]


def stored(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG for each payload, whose length must be a positive multiple of 64."""
    sizes = np.array([len(p) // 64 for p in payloads])
    images = [_fitting(int(b)) for b in sizes]
    base = np.concatenate([[0], np.cumsum([m.blocks for m in images])]).astype(np.int64)
    coef = np.zeros((base[-1], 64), np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64).astype(np.int64) - 128
    order = np.concatenate([m.units + b for m, b in zip(images, base)]) if images else np.zeros(0, np.int64)
    coef[order[T.ragged(base[:-1], sizes)]] = data
    tables = _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC4, b"\0" + b"".join(DC_SPEC)) + _segment(0xC4, b"\x10" + b"".join(AC_SPEC)) + _segment(0xDD, RESTART.to_bytes(2, "big"))
    out = []
    for m, p in zip(images, payloads):
        frame = b"\x08" + m.height.to_bytes(2, "big") + m.width.to_bytes(2, "big") + b"\3" + b"".join(bytes([c.name, c.h << 4 | c.v, 0]) for c in m.parts)
        out.append([b"\xff\xd8", _segment(0xFE, b"payload %d" % len(p)), _segment(0xC2, frame), tables])
    for parts, first, last, before, now in SCRIPT:
        if first == 0:
            counts = np.array([m.blocks for m in images])
            idx, part, each = order, np.concatenate([m.unit_part for m in images]), 6 * RESTART
        else:
            counts = np.array([m.parts[parts[0]].stride * m.parts[parts[0]].rows for m in images])
            idx, each = T.ragged(base[:-1] + [m.parts[parts[0]].base for m in images], counts), RESTART
        place = np.arange(len(idx)) - np.repeat(np.cumsum(counts) - counts, counts)
        fresh = place % each == 0
        v = coef[idx, first : last + 1]
        if first == 0 and before == 0:
            code, length, number = _dc_first(v[:, 0], part, fresh, now)
        elif first == 0:
            code, length, number = (v[:, 0] >> now) & 1, np.ones(len(v), np.int64), np.ones(len(v), np.int64)
        else:
            code, length, number = _ac_first(v, now) if before == 0 else _ac_refine(v, now)
        total = np.concatenate([[0], np.cumsum(number)])
        raw, cut = _packed(code, length, total[np.append(np.flatnonzero(fresh)[1:], len(idx))])
        head = _segment(0xDA, bytes([len(parts)]) + b"".join(bytes([YCC[c][0], 0]) for c in parts) + bytes([first, last, before << 4 | now]))
        intervals = np.concatenate([[0], np.cumsum(-(-counts // each))])
        for i, to in enumerate(out):
            to.append(head)
            for j, k in enumerate(range(intervals[i], intervals[i + 1])):
                if j:
                    to.append(bytes([0xFF, 0xD0 + (j - 1) % 8]))
                to.append(raw[cut[k] : cut[k + 1]])
    return [b"".join(x) + b"\xff\xd9" for x in out]


# --- decoding


def _parsed(buf: np.ndarray, raw: bytes, start: int, end: int, marks: np.ndarray) -> Image:
    """Headers of one image; ``marks``: places of all markers in the buffer."""
    if raw[start : start + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG stream")
    at, quants, tables, restart, image, comment = start + 2, {}, {}, 0, None, b""
    while at < end:
        while raw[at : at + 2] == b"\xff\xff":
            at += 1
        if raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = raw[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            comment = body
        elif marker == 0xC2:
            if body[0] != 8 or body[5] not in (1, 3):
                raise ValueError("only 8-bit grey or three-component images are read")
            image = _image(int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a progressive Huffman-coded image")
        elif marker == 0xDA:
            names = [c.name for c in image.parts]
            parts = [names.index(body[1 + 2 * i]) for i in range(body[0])]
            chosen = [body[2 + 2 * i] for i in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] :][:3]
            use = [tables.get(t >> 4) if first == 0 else tables.get(0x10 | t & 15) for t in chosen]
            scan = Scan(parts, first, last, bits >> 4, bits & 15, use, restart, [at])
            k = int(np.searchsorted(marks, at))
            while k < len(marks) and 0xD0 <= raw[marks[k] + 1] <= 0xD7:
                scan.starts.append(int(marks[k]) + 2)
                k += 1
            if k == len(marks) or marks[k] >= end:
                raise ValueError("a scan does not end")
            at = int(marks[k])
            image.scans.append(scan)
    else:
        raise ValueError("the stream ends early")
    if image is None:
        raise ValueError("no frame")
    image.quants, image.comment = quants, comment
    return image


class Bits:
    """Entropy-coded bytes without their stuffing, read at any bit."""

    def __init__(self, buf: np.ndarray):
        keep = np.ones(len(buf), bool)
        keep[1:] = ~((buf[1:] == 0) & (buf[:-1] == 0xFF))
        self.place = np.concatenate([[0], np.cumsum(keep)])
        self.bytes = np.concatenate([buf[keep], np.zeros(16, np.uint8)])
        self.words = np.ndarray((len(self.bytes) - 8,), ">u8", self.bytes, strides=(1,))

    def next(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from each place, at the top of a word."""
        return self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(U64) << (at & 7).astype(U64)

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[np.minimum(at >> 3, len(self.bytes) - 1)] >> (7 - (at & 7)).astype(np.uint8)) & 1


def _top(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n highest bits of each word."""
    return np.where(n > 0, word >> (64 - np.maximum(n, 1)).astype(U64), U64(0)).astype(np.int64)


class Lanes:
    """Restart intervals that are read in step: where each begins, its blocks, and its scan's parameters."""

    def __init__(self, base: np.ndarray, images: list[Image], chosen: list[tuple[int, Scan]], bits: Bits):
        seqs, parts, starts, lengths, scan_of, at = [], [], [], [], [], 0
        specs: dict = {}
        tabs = []
        for i, s in chosen:
            m = images[i]
            if len(s.parts) > 1:
                if s.parts != list(range(len(m.parts))):
                    raise ValueError("a scan interleaves some components only")
                blocks, part, each = m.units, m.unit_part, s.restart * (len(m.units) // max(1, _units(m)))
            else:
                blocks, part, each = m.parts[s.parts[0]].alone, None, s.restart
            each = each or len(blocks)
            n = -(-len(blocks) // each)
            if n > len(s.starts):
                raise ValueError("restart markers are missing")
            seqs.append(blocks + base[i])
            parts.append(part if part is not None else np.full(len(blocks), s.parts[0]))
            starts.extend(s.starts[:n])
            lengths.extend([each] * (n - 1) + [len(blocks) - each * (n - 1)])
            row = [0] * 4
            for p, spec in zip(s.parts, s.tables):
                if spec is not None:
                    row[p] = specs.setdefault(spec, len(specs))
            tabs.extend([row if s.first == 0 else [row[s.parts[0]]] * 4] * n)
            scan_of.extend([(s.first, s.last, s.now)] * n)
        self.blocks, self.parts = np.concatenate(seqs), np.concatenate(parts)
        length = np.array(lengths, np.int64)
        self.stop = np.cumsum(length)
        self.begin = self.stop - length
        self.at = bits.place[np.array(starts, np.int64)] * 8
        self.tab = np.array(tabs, np.int64) << 16
        self.first, self.last, self.low = np.array(scan_of, np.int64).T
        self.table = np.concatenate([codes(s)[2] for s in specs]) if specs else np.zeros(1 << 16, np.uint16)


def _units(m: Image) -> int:
    return len(m.units) // sum(c.h * c.v for c in m.parts)


def _checked(entry: np.ndarray) -> None:
    if not entry.all():
        raise ValueError("a code that no table has")


def _read_dc_first(l: Lanes, bits: Bits, coef: np.ndarray) -> None:
    at, now, stop, tab, low = l.at.copy(), l.begin.copy(), l.stop, l.tab, l.low
    last = np.zeros((len(at), 4), np.int64)
    while True:
        live = now < stop
        if not live.all():
            at, now, stop, tab, low, last = at[live], now[live], stop[live], tab[live], low[live], last[live]
        if not len(at):
            return
        lane, part = np.arange(len(at)), l.parts[now]
        word = bits.next(at)
        entry = l.table[tab[lane, part] + (word >> U64(48)).astype(np.int64)].astype(np.int64)
        _checked(entry)
        n, size = entry >> 8, entry & 255
        extra = _top(word << n.astype(U64), size)
        last[lane, part] += np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra)
        coef[l.blocks[now] * 64] = last[lane, part] << low
        at += n + size
        now += 1


def _read_dc_refine(l: Lanes, bits: Bits, coef: np.ndarray) -> None:
    n = l.stop - l.begin
    where = np.repeat(l.at - l.begin, n) + np.arange(len(l.blocks))
    coef[l.blocks * 64] |= bits.bit(where).astype(coef.dtype) << np.repeat(l.low, n).astype(coef.dtype)


def _read_ac_first(l: Lanes, bits: Bits, coef: np.ndarray) -> None:
    """``coef`` has one block more than the images, into which lanes that are done write."""
    spare = len(coef) - 64
    at, now, stop, tab, first, last, low = l.at.copy(), l.begin.copy(), l.stop, l.tab[:, 0], l.first, l.last, l.low
    at_k, blocks = first.copy(), np.append(l.blocks, spare // 64)
    block = blocks[now] * 64
    done = np.zeros(len(at), bool)
    while len(at):
        word = bits.next(at)
        entry = l.table[tab + (word >> U64(48)).astype(np.int64)].astype(np.int64)
        entry[done] = 0x100
        _checked(entry)
        n, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        ends = (size == 0) & (run < 15)
        take = np.where(ends, run, size)
        extra = _top(word << n.astype(U64), take)
        at += np.where(done, 0, n + take)
        at_k += run
        value = np.where(extra < (1 << size) >> 1, extra - (1 << size) + 1, extra) << low
        write = (size > 0) & (at_k <= last)
        coef[np.where(write, block + at_k, spare)] = value
        at_k += 1
        over = ends | (at_k > last)
        if over.any():
            # after an end code, its whole run of blocks is skipped
            step = np.where(ends, (1 << run) + extra, 1)
            now = np.where(over, np.minimum(now + step, stop), now)
            at_k = np.where(over, first, at_k)
            done = now >= stop
            block = np.where(done, spare, blocks[np.minimum(now, len(blocks) - 1)] * 64)
            some = int(done.sum())
            if some == len(done):
                return
            if some * 8 >= len(done):
                live = ~done
                at, now, stop, tab, first, last, low, at_k, block = (x[live] for x in (at, now, stop, tab, first, last, low, at_k, block))
                done = done[live]


def _read_ac_refine(l: Lanes, bits: Bits, coef: np.ndarray) -> None:
    spare = len(coef) - 64
    at, now, stop, tab, first, last, low = l.at.copy(), l.begin.copy(), l.stop, l.tab[:, 0], l.first, l.last, l.low
    at_k, rest = first.copy(), np.zeros(len(at), np.int64)
    width = int((last - first).max()) + 1
    while len(at):
        k = first[:, None] + np.arange(width)
        inside = k <= last[:, None]
        cells = np.where(inside, l.blocks[now][:, None] * 64 + k, spare)
        value = coef[cells]
        value[~inside] = 0
        ahead = inside & (k >= at_k[:, None])
        old, zero = ahead & (value != 0), ahead & (value == 0)
        # lanes inside a run of ended blocks read no code
        word = bits.next(at)
        entry = l.table[tab + (word >> U64(48)).astype(np.int64)].astype(np.int64)
        coded = rest == 0
        _checked(entry[coded])
        n, run, size = entry >> 8, (entry >> 4) & 15, entry & 15
        ends = coded & (size == 0) & (run < 15)
        take = np.where(ends, run, size)
        extra = _top(word << n.astype(U64), take)
        at += np.where(coded, n + take, 0)
        rest = np.where(ends, (1 << run) + extra, rest)
        whole = rest > 0
        # the place where a run of zeros ends: the (run + 1)-th zero ahead
        order = np.cumsum(zero, axis=1)
        hit = zero & (order == (run + 1)[:, None])
        land = np.where(hit.any(axis=1), hit.argmax(axis=1) + first, last + 1)
        land = np.where(whole, last + 1, land)
        fix = old & (k < land[:, None])
        rank = np.cumsum(fix, axis=1)
        row, col = np.nonzero(fix)
        one = bits.bit(at[row] + rank[row, col] - 1).astype(np.int64)
        was = value[row, col].astype(np.int64)
        coef[cells[row, col]] = was + np.where(was > 0, one, -one) * (1 << low[row])
        at += rank[:, -1]
        fresh = ~whole & (size > 0) & (land <= last)
        where = np.flatnonzero(fresh)
        coef[l.blocks[now[where]] * 64 + land[where]] = np.where(extra[where] > 0, 1, -1) << low[where]
        at_k = land + 1
        over = at_k > last
        rest = np.where(whole, rest - 1, rest)
        now, at_k = now + over, np.where(over, first, at_k)
        live = now < stop
        if not live.all():
            at, now, stop, tab, first, last, low, at_k, rest = (x[live] for x in (at, now, stop, tab, first, last, low, at_k, rest))


def coefficients(streams: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """Headers, the first block of each image, and all coefficients: one row a block, in zigzag order. Whatever a damaged
    stream leads to, the error is a ValueError."""
    try:
        return _coefficients(streams)
    except (ArithmeticError, AttributeError, LookupError, MemoryError, TypeError) as e:
        raise ValueError(f"a damaged stream: {e}") from e


def _coefficients(streams: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    raw = b"".join(streams)
    buf = np.frombuffer(raw, np.uint8)
    marks = np.flatnonzero((buf[:-1] == 0xFF) & (buf[1:] != 0) & (buf[1:] != 0xFF))
    cut = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    images = [_parsed(buf, raw, int(a), int(b), marks) for a, b in zip(cut[:-1], cut[1:])]
    base = np.concatenate([[0], np.cumsum([m.blocks for m in images])]).astype(np.int64)
    bits, coef = Bits(buf), np.zeros((int(base[-1]) + 1) * 64, np.int32)
    waves: dict[tuple, list] = {}
    for i, m in enumerate(images):
        level: dict[tuple[int, int], int] = {}
        for s in m.scans:
            cells = [(p, k) for p in s.parts for k in (range(s.first, s.last + 1))]
            now = 1 + max(level.get(c, 0) for c in cells)
            level.update(dict.fromkeys(cells, now))
            waves.setdefault((now, s.first > 0, s.before > 0), []).append((i, s))
    reader = {(False, False): _read_dc_first, (False, True): _read_dc_refine, (True, False): _read_ac_first, (True, True): _read_ac_refine}
    for key in sorted(waves):
        reader[key[1:]](Lanes(base, images, waves[key], bits), bits, coef)
    return images, base, coef[:-64].reshape(-1, 64)


def payloads(images: list[Image], base: np.ndarray, coef: np.ndarray) -> list[bytes]:
    """The bytes that ``stored`` put into the coefficients."""
    out = []
    for m, b in zip(images, base):
        n = int(m.comment.split()[1])
        out.append((coef[b + m.units[: n // 64]] + 128).astype(np.uint8).tobytes())
    return out


@lru_cache(1)
def _basis() -> np.ndarray:
    """Inverse transform of a block in zigzag order, scaled to whole numbers so that sums are exact."""
    x = np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * x[None, :] * np.pi / 16) * np.where(x == 0, np.sqrt(1 / 8), 0.5)
    two = np.einsum("yv,xu->vuyx", c, c).reshape(64, 64)[ZIGZAG]
    return np.rint(two * 8192)


def samples(images: list[Image], base: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Samples 0..255 of every block (row by row of the block). Whole numbers in double precision keep sums exact,
    so a block's samples do not depend on its neighbours."""
    scaled = coef
    if any((q != 1).any() for m in images for q in m.quants.values()):
        scaled = coef.copy()
        for m, b in zip(images, base):
            for c in m.parts:
                scaled[b + c.base : b + c.base + c.stride * c.rows] *= m.quants[c.quant].astype(np.int32)
    out = np.empty(coef.shape, np.uint8)
    for a in range(0, len(coef), 1 << 14):
        s = scaled[a : a + (1 << 14)].astype(np.float64) @ _basis()
        out[a : a + (1 << 14)] = np.clip(np.floor(s / 8192 + 128.5), 0, 255)
    return out


def rgb(m: Image, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution RGB tensor (height, width, 3) of an image's sample blocks."""
    hmax, vmax = max(c.h for c in m.parts), max(c.v for c in m.parts)
    planes = []
    for c in m.parts:
        x = blocks[c.base : c.base + c.stride * c.rows].reshape(c.rows, c.stride, 8, 8).swapaxes(1, 2).reshape(c.rows * 8, c.stride * 8)
        if (hmax // c.h, vmax // c.v) != (1, 1):
            x = x.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)
        planes.append(x[: m.height, : m.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=2)
    y, cb, cr = (p.astype(np.float32) for p in planes)
    cb -= 128
    cr -= 128
    out = np.stack([y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def tensors(streams: list[bytes]) -> list[np.ndarray]:
    """RGB tensors of progressive JPEG streams."""
    images, base, coef = coefficients(streams)
    blocks = samples(images, base, coef)
    return [rgb(m, blocks[b : b + m.blocks]) for m, b in zip(images, base)]


def feature(t: np.ndarray) -> str:
    """Size, and sums of each channel of an RGB tensor over all and over the upper half."""
    upper, lower = (x.sum(axis=(0, 1), dtype=np.int64) for x in (t[: len(t) // 2], t[len(t) // 2 :]))
    return f"{t.shape[1]}x{t.shape[0]}:" + ",".join(map(str, [*(upper + lower), *upper]))


# --- columns


def padded(raw: bytes) -> bytes:
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text as the payload of a progressive JPEG."""

    def task(batches):
        for batch in batches:
            for a, b in T.spans(batch.column("text"), PAYLOAD):
                part = batch.slice(a, b - a)
                buf, off = T.flat(part.column("text"))
                raw = buf.tobytes()
                if len(raw) > PAYLOAD:  # a long text is alone in its span
                    streams = [whole(padded(raw[x:y])) for x, y in zip(off[:-1], off[1:])]
                else:
                    streams = stored([padded(raw[x:y]) for x, y in zip(off[:-1], off[1:])])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(off)), pa.array(streams, pa.binary())], names=["id", "n_bytes", "media"])

    shared.bounded(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(T.steady(task), "id long, n_bytes long, media binary")


def _byte_spans(column, limit: int):
    sizes = np.array([len(x.as_buffer()) for x in column], np.int64)
    first, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield first, i
            first, total = i, 0
        total += s
    if len(sizes):
        yield first, len(sizes)


class Reading:
    """What is known of a row's payload after some of its images."""

    def __init__(self, pixels: bool):
        self.size, self.tail, self.digest, self.features = 0, b"", hashlib.sha256(), []
        self.pixels = pixels
        self.shapes, self.tensors = [], []

    def add(self, payload: bytes, image: Image, blocks: np.ndarray) -> None:
        self.size += len(payload)
        self.tail = payload[-64:]
        self.digest.update(payload)
        tensor = rgb(image, blocks)
        self.features.append(feature(tensor))
        if self.pixels:
            self.shapes.append([image.height, image.width])
            self.tensors.append(tensor.tobytes())


def read(media_: DataFrame, pixels: bool = False) -> DataFrame:
    """Digests, size and feature of each stored payload as read back; with ``pixels`` also the height and width of each of
    its images, and the bytes of their full-resolution RGB tensors."""

    def task(batches):
        for batch in batches:
            for a, b in _byte_spans(batch.column("media"), DECODED):
                part = batch.slice(a, b - a)
                streams, rows = part.column("media").to_pylist(), [Reading(pixels) for _ in range(b - a)]
                pieces = [(row, x) for row, s in zip(rows, streams) for x in single(s)]
                total = np.cumsum([0, *(len(x) for _, x in pieces)])
                first = 0
                while first < len(pieces):
                    last = max(first + 1, int(np.searchsorted(total, total[first] + DECODED, side="right")) - 1)
                    images, base, coef = coefficients([x for _, x in pieces[first:last]])
                    blocks = samples(images, base, coef)
                    for (row, _), payload, m, at in zip(pieces[first:last], payloads(images, base, coef), images, base):
                        row.add(payload, m, blocks[at : at + m.blocks])
                    first = last
                cols = [
                    part.column("id"), part.column("n_bytes"), pa.array([r.size for r in rows], pa.int64()), pa.array([r.digest.hexdigest() for r in rows], pa.string()),
                    pa.array([zlib.crc32(r.tail) for r in rows], pa.int64()), pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                    pa.array([";".join(r.features) for r in rows], pa.string()),
                ]
                if pixels:
                    cols += [pa.array([r.shapes for r in rows], pa.list_(pa.list_(pa.int32()))), pa.array([r.tensors for r in rows], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", shapes array<array<int>>, rgb array<binary>" if pixels else "")
    names = [f.split()[0] for f in fields.split(", ")]
    return media_.mapInArrow(T.steady(task), fields)


def tensors_written(media_: DataFrame, folder: str) -> DataFrame:
    """The RGB tensors of stored payloads as a Parquet table under ``folder``: id, digests, shapes and tensors, read again."""
    read(media_, pixels=True).write.parquet(folder)
    return media_.sparkSession.read.parquet(folder)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(media(docs)).withColumnRenamed("id", "doc_id")
