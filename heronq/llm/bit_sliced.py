"""Exact top-k inner-product search by a bit-sliced index.

Components are quantised to integers. The index keeps, for each block of vectors and each component, one bitmap a
binary digit: bit r of a slice is that digit of row r's component above the block's least. A query's score for all rows of a
block at once is a sum of slices: its own components are written in signed digits, a digit +-2^j adds the component's slices
(or their complements, up to a constant) at weights j upwards, and all slices of equal weight are added with carry-save
full adders of bitmaps. The scores are then themselves bit-sliced, and the best k rows are found from the most significant
slice downwards: rows are certainly in, still open, or out. Rows open after the last slice are equal in score, and these
boundary rows are settled by id, as a block's rows stand in order of id.

Blocks and batches of queries are files in the shared folder; a task reads one batch and a span of blocks and returns k rows
a query, so vectors are shuffled once to build the index, and no more. All queries meet all blocks: the arithmetic is
the product of both numbers, as an exact answer to arbitrary queries costs. Memory is bounded by BLOCK_CELLS and BATCH.

Defined results: null vectors and those with null or non-finite components take no part, nor do those whose quantised
components pass 32 bits or whose squares add up to 2^63 or more (below that every score fits a long). Only vectors of
equal length have a score; vectors without components score 0 among themselves. A row is no candidate of its own query, but
another row with the same id is, and rows that repeat a query's id are queries of their own. A null id is never a
query by the default predicate; as a candidate it ranks after all ids of its score. No rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronq.llm.common import arrow_map, batch, settle, shared_dir
from heronq.llm.storage import read_arrays, write_arrays

#: Components in a block (its rows times their length), about.
BLOCK_CELLS = 1 << 21
#: Queries in a batch, about, and blocks that a task searches for one batch.
BATCH, SPAN = 128, 32

_CODES = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("codes", pa.binary())])
_FILES = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("path", pa.string())])
_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, column: str, scale: float) -> DataFrame:
    """(vec_id, dim, codes: floor(scale * x) as little-endian 32-bit integers), of the rows that take part."""

    def run(batches):
        for b in batches:
            keep, dims, codes = [], [], []
            for k, v in enumerate(b.column(1)):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    fits = np.isfinite(x).all() and (np.abs(x) < 2.0**31).all()
                if fits and (not len(x) or sum(int(c) ** 2 for c in x[np.abs(x) > 2.0**20]) + float((x[np.abs(x) <= 2.0**20] ** 2).sum()) < 2**63):
                    keep.append(k)
                    dims.append(len(x))
                    codes.append(x.astype("<i4").tobytes())
            yield batch(_CODES, b.column(0).cast(pa.int64()).take(pa.array(keep, pa.int64())), dims, codes)

    return arrow_map(vectors.select("vec_id", column), run, "vec_id long, dim int, codes binary")


def matrix(codes: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), "<i4").reshape(len(codes), dim).astype(np.int64)


def slice_block(x: np.ndarray) -> dict[str, np.ndarray]:
    """Integers (rows, components) -> least of each component, where its slices begin, and all slices, as words of 64 rows."""
    low = x.min(axis=0) if len(x) else np.zeros(x.shape[1], np.int64)
    u = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.int64)
    u[: len(x)] = x - low
    width = np.array([int(m).bit_length() for m in u.max(axis=0)], np.int64) if len(u) else np.zeros(x.shape[1], np.int64)
    first = np.concatenate([[0], np.cumsum(width)])
    slices = np.zeros((first[-1], len(u) // 64), np.uint64)
    for i in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > i)
        bits = np.packbits(((u[:, has] >> i) & 1).astype(np.uint8), axis=0, bitorder="little")
        slices[first[has] + i] = np.ascontiguousarray(bits.T).view(np.uint64)
    return {"low": low, "first": first, "slices": slices}


def signed_digits(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every number as the fewest signed powers of two: (which number, exponent, whether negative)."""
    at, power, minus = [], [], []
    n, j = q.astype(np.int64).copy(), 0
    while n.any():
        odd = (n & 1) == 1
        digit = np.where(odd, 2 - (n & 3), 0)
        k = np.flatnonzero(odd)
        at.append(k)
        power.append(np.full(len(k), j))
        minus.append(digit[k] < 0)
        n = (n - digit) >> 1
        j += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, d) for x, d in ((at, np.int64), (power, np.int64), (minus, bool)))


def add_slices(q: np.ndarray, low: np.ndarray, first: np.ndarray, slices: np.ndarray) -> tuple[list[np.ndarray], int]:
    """The scores of all rows as slices, least significant first, and the constant that each lacks."""
    at, power, minus = signed_digits(q)
    width = np.diff(first)
    constant = sum(int(a) * int(b) for a, b in zip(q, low))
    constant -= sum((1 << int(j)) * ((1 << int(w)) - 1) for j, w in zip(power[minus], width[at[minus]]))
    # each digit of the query meets each slice of its component
    terms = np.repeat(np.arange(len(at)), width[at])
    place = np.arange(len(terms)) - np.repeat(np.cumsum(width[at]) - width[at], width[at])
    which, weight, flip = first[at[terms]] + place, power[terms] + place, minus[terms]
    order = np.argsort(weight, kind="stable")
    which, flip, ends = which[order], flip[order], np.searchsorted(weight[order], np.arange(weight.max(initial=-1) + 2))
    sums, carries, w = [], [], 0
    while w + 1 < len(ends) or carries:
        column = carries
        carries = []
        if w + 1 < len(ends) and ends[w] < ends[w + 1]:
            some = slices[which[ends[w] : ends[w + 1]]]
            flipped = flip[ends[w] : ends[w + 1]]
            if flipped.any():
                some ^= np.where(flipped, ~np.uint64(0), np.uint64(0))[:, None]
            column = [*column, some]
        bits = np.concatenate(column) if column else np.zeros((1, slices.shape[1]), np.uint64)
        while len(bits) > 2:
            t = len(bits) // 3
            a, b, c = bits[:t], bits[t : 2 * t], bits[2 * t : 3 * t]
            either = a ^ b
            a &= b
            a |= np.bitwise_and(either, c, out=b)
            carries.append(a)
            either ^= c
            bits = np.concatenate([either, bits[3 * t :]])
        if len(bits) == 2:
            carry = bits[:1] & bits[1:]
            if carry.any():
                carries.append(carry)
            bits = bits[:1] ^ bits[1:]
        sums.append(bits[0])
        w += 1
    return sums, constant


def best_rows(sums: list[np.ndarray], exists: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of the greatest sums, or of all; among equal sums at the boundary the first."""
    sure, open_, taken = np.zeros_like(exists), exists, 0
    if int(np.bitwise_count(open_).sum()) <= k:
        return positions(open_)
    for s in reversed(sums):
        ones = open_ & s
        n = int(np.bitwise_count(ones).sum())
        if taken + n > k:
            open_ = ones
        else:
            sure |= ones
            taken += n
            open_ = open_ & ~s
            if taken == k:
                return positions(sure)
    return np.concatenate([positions(sure), positions(open_)[: k - taken]])


def positions(bits: np.ndarray) -> np.ndarray:
    """Of the ones, ascending."""
    words = np.flatnonzero(bits)
    inside = np.unpackbits(np.ascontiguousarray(bits[words]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(inside)
    return words[r] * 64 + c


def sum_at(sums: list[np.ndarray], row: int) -> int:
    word, bit = divmod(int(row), 64)
    return sum((int(s[word]) >> bit & 1) << w for w, s in enumerate(sums))


def search_block(q: np.ndarray, own: int, block: dict[str, np.ndarray], k: int) -> list[tuple[int, int]]:
    """(score, position) of the best k rows of a block for one query; own is the query's row number."""
    exists = block["exists"]
    at = int(np.searchsorted(block["row_sorted"], own))
    if at < len(block["row_sorted"]) and block["row_sorted"][at] == own:
        mine = int(block["row_order"][at])
        exists = exists.copy()
        exists[mine // 64] &= ~(np.uint64(1) << np.uint64(mine % 64))
    sums, constant = add_slices(q, block["low"], block["first"], block["slices"])
    return [(sum_at(sums, p) + constant, int(p)) for p in best_rows(sums, exists, k)]


def opened(path: str) -> dict[str, np.ndarray]:
    """A block as it is searched."""
    block = read_arrays(path)
    n = len(block["row"])
    bits = np.zeros(block["slices"].shape[1] * 64 if block["slices"].size else -(-n // 64) * 64, np.uint8)
    bits[:n] = 1
    block["exists"] = np.packbits(bits, bitorder="little").view(np.uint64)
    if not block["slices"].size:
        block["slices"] = np.zeros((0, len(block["exists"])), np.uint64)
    block["row_order"] = np.argsort(block["row"])
    block["row_sorted"] = block["row"][block["row_order"]]
    return block


def build_index(vectors: DataFrame, column: str, scale: float, is_query: Column, cells: int, queries: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: blocks and batches of queries (dim, part, path), and the number of both for each length."""
    spark = vectors.sparkSession
    rows = settle(quantised(vectors, column, scale).withColumn("row", F.monotonically_increasing_id()), "quantised")
    asks = F.coalesce(is_query, F.lit(False)).cast("long")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(asks).alias("q"))
    per_block = F.greatest(F.lit(64), F.lit(cells) / F.greatest("dim", F.lit(1)))
    sizes = settle(sizes.select("dim", F.ceil(F.col("n") / per_block).cast("long").alias("blocks"), F.ceil(F.col("q") / queries).cast("long").alias("batches")), "sizes")
    folder = shared_dir(spark)

    def write_block(t: pa.Table) -> pa.Table:
        dim, part = t["dim"][0].as_py(), t["part"][0].as_py()
        t = t.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # null ids last
        known = t["vec_id"].is_valid().to_numpy()
        path = write_arrays(folder, f"block-{dim}-{part}", row=t["row"].to_numpy(), known=known, vec_id=t["vec_id"].fill_null(0).to_numpy(), **slice_block(matrix(t["codes"], dim)))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(([dim], [part], [path]), _FILES)], schema=_FILES)

    def write_batch(t: pa.Table) -> pa.Table:
        dim, part = t["dim"][0].as_py(), t["part"][0].as_py()
        path = write_arrays(folder, f"batch-{dim}-{part}", row=t["row"].to_numpy(), vec_id=t["vec_id"].to_numpy(), codes=matrix(t["codes"], dim))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(([dim], [part], [path]), _FILES)], schema=_FILES)

    part = lambda n: F.pmod(F.xxhash64("row", F.lit(5)), F.col(n))
    known = rows.join(sizes, "dim")
    to = "dim int, part long, path string"
    blocks = known.select("dim", part("blocks").alias("part"), "row", "vec_id", "codes").groupBy("dim", "part").applyInArrow(write_block, to)
    batches = known.where(is_query & F.col("vec_id").isNotNull()).select("dim", part("batches").alias("part"), "row", "vec_id", "codes").groupBy("dim", "part").applyInArrow(write_batch, to)
    return settle(blocks, "blocks"), settle(batches, "batches"), sizes


def top_k(vectors: DataFrame, k: int = 20, column: str = "embedding", scale: float = 64.0, is_query: Column | None = None, cells: int = BLOCK_CELLS, queries: int = BATCH, span: int = SPAN) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): each query row's k best among all other rows."""
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    blocks, batches, sizes = build_index(vectors, column, scale, is_query, cells, queries)
    spans = blocks.groupBy("dim", F.floor(F.col("part") / span).alias("span")).agg(F.sort_array(F.collect_list("path")).alias("paths"))
    pairs = batches.join(sizes, "dim").select("dim", "part", "path", F.explode(F.expr(f"sequence(0L, (blocks - 1) div {span})")).alias("span"))
    pairs = settle(pairs.join(spans, ["dim", "span"]).select("dim", "part", "span", "path", "paths"), "pairs")
    n = min(pairs.count(), 100_000)

    def search(found):
        for b in found:
            for path, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                asked = read_arrays(path)
                best: list[list] = [[] for _ in asked["row"]]
                for p in paths:
                    block = opened(p)
                    for i, (q, own) in enumerate(zip(asked["codes"], asked["row"])):
                        new = [(-s, not block["known"][r], int(block["vec_id"][r]), int(block["row"][r])) for s, r in search_block(q, int(own), block, k)]
                        best[i] = heapq.nsmallest(k, best[i] + new)
                flat = [(int(asked["row"][i]), int(asked["vec_id"][i]), row, None if unknown else vec, -s) for i, rows in enumerate(best) for s, unknown, vec, row in rows]
                yield batch(_FOUND, *(list(zip(*flat)) or [[]] * 5))

    tasks = pairs.repartitionByRange(max(1, n), "dim", "part", "span").select("path", "paths")
    found = settle(arrow_map(tasks, search, "query_row long, query_id long, row long, vec_id long, score long"), "found")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
