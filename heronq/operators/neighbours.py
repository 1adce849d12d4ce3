"""Exact nearest neighbours by cosine, pruned by pivots and the triangle inequality of angles.

Vectors are dealt by their nearest pivot and their angle to it, once, so that rows next to each other lie in a thin shell around
a pivot. Queries go out in chunks of bounded size; each task passes over its rows in strips, and a query skips a strip when its
angle to some pivot differs from all of the strip's by more than the angle of its k-th neighbour so far, since no row of the strip can
be nearer then. A task keeps k rows a query and returns them; a window takes the best k of all tasks. The k-th angle never
shrinks below the true one, so the answer is exact whatever is skipped; how much is depends on the data.

Neighbours are ranked by cosine rounded to PLACES, then by id, so ties do not depend on the order of sums. Defined results: null
vectors, empty ones, zeros and those with null or non-finite components take no part; only vectors of equal length are compared; a
row is no neighbour of itself, but of rows with the same id; null ids rank last among ties and are no queries by default; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronq.sources.scratch import settled

PIVOTS, STRIP, PLACES = 16, 1024, 9
#: Queries that meet a strip at once: a task's memory beside its queries and their k rows is that of BLOCK * STRIP cosines.
BLOCK = 1024
#: Bytes of the queries sent out at once, or of the rows that a task keeps for them if these are more.
CHUNK_BYTES = 16 << 20
_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])


def unit_vectors(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, dim, unit: components as little-endian doubles) of the rows that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])

    def run(batches):
        for b in batches:
            keep, dims, units = [], [], []
            for k, v in enumerate(b.column(1)):
                x = None if not v.is_valid or not len(v.values) or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if x is not None and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    keep.append(k)
                    dims.append(len(x))
                    units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64())), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], schema=schema)

    return vectors.select("vec_id", column).mapInArrow(run, "vec_id long, dim int, unit binary")


def matrix(units: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(units.to_pylist()), "<f8").reshape(-1, dim)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def dealt(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows in order of nearest pivot and angle to it."""
    dim = pivots.shape[1]
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("unit", pa.binary()), ("cell", pa.int32()), ("angle", pa.float64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                far = angles(matrix(b.column(2), dim), pivots)
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(far)), cell])], schema=schema)

    near = rows.select("row", "vec_id", "unit").mapInArrow(run, "row long, vec_id long, unit binary, cell int, angle double")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    return settled(near.repartitionByRange(parts, "cell", "angle", "row").sortWithinPartitions("cell", "angle"), "dealt")


def best(q: np.ndarray, cosine: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each query's k best of flat hits, and their ranks."""
    order = np.lexsort((row, vec_id, -cosine, q))
    sorted_q = q[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_q, sorted_q)
    return order[rank < k], rank[rank < k]


def pass_over(batches, asked, pivots: np.ndarray, k: int):
    """A task's k best rows for each query asked: (row, id, unit vectors)."""
    q_row, q_id, x = asked
    from_pivots = angles(x, pivots)
    kth, reach = np.full(len(x), -np.inf), np.full(len(x), np.pi)
    last = np.iinfo(np.int64).max  # for null ids
    none = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    blocks = [slice(lo, lo + BLOCK) for lo in range(0, len(x), BLOCK)]
    held = [none for _ in blocks]
    for b in batches:
        for at in range(0, b.num_rows, STRIP):
            s = b.slice(at, STRIP)
            y = matrix(s.column(2), x.shape[1])
            row, vec_id = s.column(0).to_numpy(), s.column(1).fill_null(last).to_numpy()
            shell = angles(y, pivots)
            low, high = shell.min(axis=0), shell.max(axis=0)
            for n, part in enumerate(blocks):
                gap = np.maximum(from_pivots[part] - high, low - from_pivots[part]).max(axis=1)
                on = part.start + np.flatnonzero(gap <= reach[part] + 1e-6)
                if not len(on):
                    continue
                cosine = np.round(x[on] @ y.T, PLACES)
                cosine[row[None, :] == q_row[on][:, None]] = -np.inf
                least = kth[on]
                new = np.isinf(least)
                if new.any() and len(row) > k:  # the k-th of the strip is a bound where there is none yet
                    least[new] = np.partition(cosine[new], len(row) - k, axis=1)[:, len(row) - k]
                i, j = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
                if not len(i):
                    continue
                hits = [on[i], cosine[i, j], vec_id[j], row[j]]
                mine = [np.concatenate(pair) for pair in zip(held[n], hits)]
                keep, rank = best(*mine, k)
                held[n] = mine = [h[keep] for h in mine]
                full = rank == k - 1
                kth[mine[0][full]] = mine[1][full]
                reach[part] = np.arccos(np.clip(np.where(np.isfinite(kth[part]), kth[part], -1), -1, 1))
    for q, cosine, vec_id, row in held or [none]:
        yield pa.RecordBatch.from_arrays([pa.array(q_row[q]), pa.array(q_id[q]), pa.array(row), pa.array(vec_id, mask=vec_id == last), pa.array(cosine)], schema=_FOUND)


def exact_neighbours(vectors: DataFrame, k: int = 20, is_query: Column | None = None, column: str = "embedding", pivots: int = PIVOTS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, cosine): each query row's k nearest among all other rows."""
    spark = vectors.sparkSession
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    rows = settled(unit_vectors(vectors, column).withColumn("row", F.monotonically_increasing_id()), "rows")
    asks = rows.where(is_query & F.col("vec_id").isNotNull())
    parts = []
    for dim, n in asks.groupBy("dim").count().orderBy("dim").collect():
        some = rows.where(F.col("dim") == dim)
        base = matrix(some.orderBy(F.xxhash64("row", F.lit(7)), "row").limit(pivots).select("unit").toArrow().column(0), dim)
        table = dealt(some, base)
        chunks = -(-n * max(dim, 4 * k) * 8 // chunk_bytes)
        for c in range(chunks):
            mine = asks.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("row", F.lit(3)), F.lit(chunks)) == c)).select("row", "vec_id", "unit").toArrow()
            if not mine.num_rows:
                continue
            sent = spark.sparkContext.broadcast((mine["row"].to_numpy(), mine["vec_id"].to_numpy(), matrix(mine["unit"], dim)))
            run = lambda batches, sent=sent, base=base: pass_over(batches, sent.value, base, k)
            parts.append(settled(table.select("row", "vec_id", "unit").mapInArrow(run, "query_row long, query_id long, row long, vec_id long, cosine double"), "found"))
            sent.destroy()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, cosine double")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.desc("cosine"), F.asc_nulls_last("vec_id"), "row")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
