"""Sets of runs of words for functions that Spark hands Arrow batches: numpy on the UTF-8 bytes of many texts at once, no object a word.

Words are those of heronq.functions.text, with A-Z in lower case. Bytes 0x20 and 0x09-0x0D are never part of a longer UTF-8 character.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows that Spark hands out at once, bytes of those worked on together (a longer row is alone), and bytes hashed at once.
BATCH_ROWS, BATCH_BYTES, HASH_BYTES = 512, 4 << 20, 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_VALUE = np.random.Generator(np.random.PCG64(1)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


@contextmanager
def small_batches(spark: SparkSession):
    """Spark hands out BATCH_ROWS rows at once while this lasts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_BYTES, or of one row."""
    for b in batches:
        todo = [b]
        while todo:
            part = todo.pop()
            if part.nbytes <= BATCH_BYTES or part.num_rows < 2:
                yield part
            else:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte of each word and the byte after it, and the index of each text's first word, with the end."""
    letter = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = ~letter[:-1] | edge[1:-1]
    after[:-1] = ~letter[1:] | edge[1:-1]
    starts = np.flatnonzero(letter & before)
    return starts, np.flatnonzero(letter & after) + 1, np.searchsorted(starts, offsets)


def _value(part: np.ndarray) -> int:
    """The hash of a block's bytes, before mixing."""
    return int((_VALUE[part] * _powers[0][: len(part)]).sum(dtype=np.uint64))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its bytes' values times powers, from running sums over blocks of whole words."""
    if not _powers:
        for p in (_P, pow(_P, -1, 1 << 64)):
            x = np.full(HASH_BYTES + 1, p, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    power, inverse = _powers
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + HASH_BYTES, "right")))
        z = int(ends[j - 1])
        if z - a > HASH_BYTES:  # one word longer than a block
            step, parts = pow(_P, HASH_BYTES, 1 << 64), range(a, z, HASH_BYTES)
            out[i] = sum(pow(step, k, 1 << 64) * _value(data[at : min(at + HASH_BYTES, z)]) for k, at in enumerate(parts)) % (1 << 64)
        else:
            total = np.zeros(z - a + 1, np.uint64)
            np.cumsum(_VALUE[data[a:z]] * power[: z - a], out=total[1:])
            s = starts[i:j] - a
            out[i:j] = (total[ends[i:j] - a] - total[s]) * inverse[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each place."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : k + m]
    return mix(h)


def run_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its runs of n words, or of all its words as one run if they are fewer."""
    data, offsets = _bytes(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    data = _LOWER[data]
    starts, ends, first = _words(data, offsets)
    words = _word_hashes(data, starts, ends)
    runs = _run_hashes(words, n)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            g = np.sort(runs[a : z - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif z > a:
            out.append(mix(_run_hashes(words[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
