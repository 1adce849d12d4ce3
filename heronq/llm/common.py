"""What the text operators share: Arrow plumbing, byte-level word kernels, shared-folder tables.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Those bytes never occur inside a
multi-byte UTF-8 character, so every kernel below works on the UTF-8 buffer of an Arrow array
directly and never makes one Python object per word.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch handed to Python, and bytes of those worked on together (a longer row is alone): they bound a
#: worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
#: Bytes hashed at once.
HASH_BYTES = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_CONT = (np.arange(256) & 0xC0) == 0x80

_P = np.uint64(0x9E3779B97F4A7C15)  # 5 mod 8, so its powers have the longest period there is
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def small_batches(spark: SparkSession) -> None:
    """Hands rows to Python in batches of BATCH_ROWS from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; below a local one where that is unset and there is only
    this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="heronq-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/heronq-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets the driver drop the shuffle files of plans that are done: they go when their last reference is collected."""
    gc.collect()
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Deletes the files of a settled table that nothing lazy needs any more."""
    spark = df.sparkSession
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes, or of one row."""
    for b in batches:
        todo = [b]
        while todo:
            part = todo.pop()
            if part.nbytes <= most or part.num_rows < 2:
                yield part
            else:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: fn(bounded(batches)), schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of df, all columns, for which a function of one column's Arrow array says True. make() is called once a task."""

    def run(batches):
        keep = make()
        for b in bounded(batches):
            yield b.filter(pa.array(keep(b.column(at))))

    at = df.columns.index(column)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its offsets (one more than rows); nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each row's first word (one more than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[1:]
    edge[offsets] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, in UTF-8."""
    low = LOWER[data]
    if len(low) > 1:
        after = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[after] += 0x20
    return low


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for p in (_P, _P_INV):
            x = np.full(HASH_BYTES + 1, p, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers[0][:n], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by prefix sums of byte values times powers modulo 2**64."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + HASH_BYTES, "right")))
        b = ends[j - 1]
        if b - a > HASH_BYTES:  # one word longer than a block
            h, scale, step = 0, 1, pow(int(_P), HASH_BYTES, 1 << 64)
            for k in range(int(a), int(b), HASH_BYTES):
                part = data[k : min(k + HASH_BYTES, int(b))]
                h += scale * int((_BYTE[part] * _power(len(part))[0]).sum(dtype=np.uint64))
                scale = scale * step % (1 << 64)
            out[i] = h % (1 << 64)
        else:
            part = data[a:b]
            power, inverse = _power(len(part))
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[part] * power, out=total[1:])
            s = starts[i:j] - a
            out[i:j] = (total[ends[i:j] - a] - total[s]) * inverse[s]
        i = j
    return mix(out ^ (ends - starts).astype(np.uint64))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position; n - 1 shorter than words. Rows are not told apart here."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[k : k + m]
    return mix(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
