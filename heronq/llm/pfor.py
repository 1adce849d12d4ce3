"""Patched frame-of-reference files of token ids.

File: magic, blocks, a footer and its place. A block holds BLOCK values: its minimum (u32), the
count of exceptions (u16), the width (u8), the values less the minimum packed at that width, and
for each exception its place (u8) and the bits above the width (u32). The width is the least that
holds a percentile of the block's values; the rest are exceptions. Packing is vertical: value i of
a block stands at bit i * width of its 64-bit words. The footer holds the byte at which every
block starts, the documents (id, count of tokens, a bit for those without id) and the count of values, so a range of
values is read by seeking to its blocks. A short last block is padded with its own minimum.

Documents may have no id (null); nulls and empty texts are documents of the end id alone; an empty table makes no file or one
without blocks. Ids must fit 32 bits unsigned.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"HQPFOR2\n"
BLOCK = 128
#: Share of a block's values that its width must hold.
PERCENTILE = 0.9


def bit_widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0).astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, BLOCK) of values below 2**width -> (blocks, words) of little-endian u64."""
    n = len(values)
    words = np.zeros((BLOCK * width // 64, n), np.uint64)
    lanes = np.ascontiguousarray(values.T.astype(np.uint64))
    for i in range(BLOCK if width else 0):
        k, shift = divmod(i * width, 64)
        words[k] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[k + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words)
    lanes = np.zeros((BLOCK, n), np.uint64)
    cols, mask = np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    for i in range(BLOCK if width else 0):
        k, shift = divmod(i * width, 64)
        lanes[i] = cols[k] >> np.uint64(shift)
        if shift + width > 64:
            lanes[i] |= cols[k + 1] << np.uint64(64 - shift)
    return (lanes & mask).T


def encode_blocks(values: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """One byte string for each block of BLOCK values; the last is padded."""
    if not len(values):
        return []
    short = -len(values) % BLOCK
    if short:
        values = np.concatenate([values, np.full(short, values[-(BLOCK - short) :].min(), values.dtype)])
    blocks = values.reshape(-1, BLOCK).astype(np.uint64)
    low = blocks.min(axis=1)
    blocks -= low[:, None]
    need = bit_widths(blocks)
    at = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(need, at, axis=1)[:, at]
    out: list[bytes] = [b""] * len(blocks)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        mine = blocks[rows]
        packed = pack(mine & np.uint64((1 << int(w)) - 1), int(w))
        r, p = np.nonzero(need[rows] > w)
        high = (mine[r, p] >> np.uint64(w)).astype("<u4")
        edges = np.searchsorted(r, np.arange(len(rows) + 1))
        p = p.astype(np.uint8)
        for i, row in enumerate(rows.tolist()):
            a, b = edges[i], edges[i + 1]
            out[row] = struct.pack("<IHB", int(low[row]), b - a, int(w)) + packed[i].tobytes() + p[a:b].tobytes() + high[a:b].tobytes()
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The values of the blocks that start at these bytes of raw."""
    buf = np.frombuffer(raw, np.uint8)
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    head = buf[starts[:, None] + np.arange(7)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0].astype(np.uint64)
    count = np.ascontiguousarray(head[:, 4:6]).view("<u2")[:, 0].astype(np.int64)
    width = head[:, 6]
    out = np.empty((n, BLOCK), np.uint64)
    for w in np.unique(width):
        rows, w = np.flatnonzero(width == w), int(w)
        size = BLOCK * w // 8
        packed = np.ascontiguousarray(buf[starts[rows, None] + 7 + np.arange(size)])
        values = np.ascontiguousarray(unpack(packed.view("<u8"), w)) if w else np.zeros((len(rows), BLOCK), np.uint64)
        c = count[rows]
        total = int(c.sum())
        if total:
            r = np.repeat(np.arange(len(rows)), c)
            k = np.arange(total) - np.repeat(np.cumsum(c) - c, c)
            base = starts[rows] + 7 + size
            place = buf[base[r] + k]
            high = np.ascontiguousarray(buf[(base[r] + c[r] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0]
            values[r, place] |= high.astype(np.uint64) << np.uint64(w)
        out[rows] = values
    out += low[:, None]
    return out.reshape(-1).astype(np.uint32)


class Writer:
    """Writes documents of ids to an open binary stream, holding CHUNK values at most."""

    CHUNK = BLOCK * 4096

    def __init__(self, stream, percentile: float = PERCENTILE):
        self.stream, self.percentile = stream, percentile
        self.at = len(MAGIC)
        self.starts, self.ids, self.lengths, self.held, self.n_held, self.total = [], [], [], [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.total += len(ids)
        if self.n_held >= self.CHUNK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(values) if last else len(values) // BLOCK * BLOCK
        for k in range(0, whole, self.CHUNK):
            blocks = encode_blocks(values[k : min(k + self.CHUNK, whole)], self.percentile)
            sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
            self.starts.append(self.at + np.cumsum(sizes) - sizes)
            self.at += int(sizes.sum())
            self.stream.write(b"".join(blocks))
        self.held = [values[whole:]]
        self.n_held = len(values) - whole

    def close(self) -> int:
        self._flush(True)
        starts = np.concatenate(self.starts) if self.starts else np.zeros(0, np.int64)
        self.stream.write(starts.astype("<u8").tobytes() + np.asarray([d or 0 for d in self.ids], "<i8").tobytes() + np.asarray(self.lengths, "<u8").tobytes() + np.packbits([d is None for d in self.ids]).tobytes())
        self.stream.write(struct.pack("<QQQQ", self.at, len(starts), len(self.ids), self.total) + MAGIC)
        return self.at


class Reader:
    """Reads a file through a seekable stream, a range of blocks at a time."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        stream.seek(size - 32 - len(MAGIC))
        tail = stream.read(32 + len(MAGIC))
        if tail[32:] != MAGIC:
            raise ValueError("not a whole file of this format")
        at, n, docs, self.total = struct.unpack("<QQQQ", tail[:32])
        stream.seek(at)
        self.end = at
        self.starts = np.frombuffer(stream.read(8 * n), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
        self.lengths = np.frombuffer(stream.read(8 * docs), "<u8").astype(np.int64)
        self.nameless = np.unpackbits(np.frombuffer(stream.read(-(-docs // 8)), np.uint8), count=docs).astype(bool)

    def values(self, a: int, b: int) -> np.ndarray:
        """ids a to b - 1 of the file."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        start = int(self.starts[first])
        stop = int(self.starts[last + 1]) if last + 1 < len(self.starts) else self.end
        self.stream.seek(start)
        got = decode_blocks(self.stream.read(stop - start), self.starts[first : last + 1] - start)
        return got[a - first * BLOCK : b - first * BLOCK]

    def doc_id(self, k: int) -> int | None:
        return None if self.nameless[k] else int(self.doc_ids[k])

    def documents(self, chunk: int = Writer.CHUNK) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids before it in the file, count, crc32 of its ids), holding about chunk values."""
        ends = np.cumsum(self.lengths)
        i, n = 0, len(ends)
        while i < n:
            a = int(ends[i] - self.lengths[i])
            j = max(i + 1, int(np.searchsorted(ends, a + chunk, "right")))
            b = int(ends[j - 1])
            if j == i + 1 and b - a > chunk:  # one long document, part by part
                crc = 0
                for k in range(a, b, chunk):
                    crc = zlib.crc32(self.values(k, min(k + chunk, b)).astype("<u4"), crc)
                yield self.doc_id(i), a, b - a, crc
            else:
                raw = self.values(a, b).astype("<u4")
                for d in range(i, j):
                    s, e = int(ends[d] - self.lengths[d]) - a, int(ends[d]) - a
                    yield self.doc_id(d), s + a, e - s, zlib.crc32(raw[s:e])
            i = j
