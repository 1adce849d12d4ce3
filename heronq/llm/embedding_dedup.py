"""Embedding near-dedup: int8 quantised tile products with rigorous error bounds.

Equal vectors are first folded into a class with a weight and a number of its own. The classes are dealt into tiles by hash,
a tile is a file in the shared folder, and each pair of tiles is one task, which reads its two files; vectors are shuffled once. A unit vector u is quantised as s*q with int8 q, and its error
e = |u - s*q| is measured, so |u.v - s*t*(q.r)| <= e_u (|t*r| + e_v) + |s*q| e_v for any v = t*r + error.
Products of int8 codes are exact in float32 arithmetic. Pairs whose upper bound is below the threshold
are done; pairs whose lower bound reaches it are links; only those between are recomputed in
double precision. A task returns sums of links and a spanning forest, never its pairs.

All pairs of tiles are compared, so time grows with the square of the distinct vectors: that is what
an exact answer at any cosine costs. Memory of a task is bounded by TILE.

Defined results: null, empty and zero vectors and those with null or non-finite components link with
nothing; vectors of different lengths never link; rows with equal vec_ids count as vectors of their
own, equal in vector or not; rows with null vec_ids take part, but a null names a component only where all its ids are null;
labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import arrow_map, batch, settle, shared_dir
from heronq.llm.components import connected_components
from heronq.llm.storage import read_arrays, write_arrays

TILE = 4096
#: Rows of a tile multiplied at once.
STRIP = 512
#: Pairs recomputed at once.
EXACT = 1 << 15
#: Tasks at most; beyond that a task compares several pairs of tiles.
MOST_TASKS = 100_000
#: Room for rounding in double precision.
SLACK = 1e-12


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Finite rows, none zero -> unit rows, int8 codes, scales, norms of the quantised rows, bounds of their errors."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    error = np.sqrt(((unit - near) ** 2).sum(axis=1)) + SLACK
    return unit, codes, scale, np.sqrt((near * near).sum(axis=1)) + SLACK, error


def codes_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of int8 codes without rounding: float32 holds sums of up to 1040 products exactly."""
    out = None
    for k in range(0, a.shape[1], 1024):
        part = a[:, k : k + 1024].astype(np.float32) @ b[:, k : k + 1024].astype(np.float32).T
        out = part if out is None else out.astype(np.float64) + part
    return out


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[i] and b[i] in place; root holds each node's class, the least node of it."""
    while len(a):
        ra, rb = root[a], root[b]
        on = ra != rb
        if not on.any():
            return
        a, b, ra, rb = a[on], b[on], ra[on], rb[on]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root[:] = deeper


def tile_links(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between rows of x and y (of x among themselves if same): weights linked to each row of x and of y, and each
    node's class, nodes of y numbered after those of x."""
    ux, qx, sx, nx, ex = quantise(x)
    uy, qy, sy, ny, ey = (ux, qx, sx, nx, ex) if same else quantise(y)
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    root = np.arange(len(x) + (0 if same else len(y)))
    far = 0 if same else len(x)
    sy32 = sy.astype(np.float32)
    for k in range(0, len(x), STRIP):
        rows = slice(k, min(k + STRIP, len(x)))
        product = codes_product(qx[rows], qy)
        # first against the loosest bound of the strip's rows, with room for float32 rounding
        loose = ex[rows] * (ny.max() + ey.max()) + nx[rows] * ey.max()
        least = (threshold - loose - 1e-5) / sx[rows]
        r, c = np.nonzero(product * sy32 >= least[:, None].astype(np.float32))
        if same:
            upper = c > r + k
            r, c = r[upper], c[upper]
        i = r + k
        near = product[r, c].astype(np.float64) * sx[i] * sy[c]
        bound = ex[i] * (ny[c] + ey[c]) + nx[i] * ey[c] + SLACK
        link = near - bound >= threshold
        open_ = np.flatnonzero(~link & (near + bound >= threshold))
        for m in range(0, len(open_), EXACT):
            some = open_[m : m + EXACT]
            link[some] = cosine(x[i[some]], y[c[some]]) >= threshold
        i, c = i[link], c[link]
        cx += np.bincount(i, wy[c], minlength=len(x)).astype(np.int64)
        cy += np.bincount(c, wx[i], minlength=len(y)).astype(np.int64)
        unite(root, i, c + far)
    return cx, cy, root


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))


_CLEAN = pa.schema([("vec_id", pa.int64()), ("vector", pa.binary())])


def clean_vectors(embeddings: DataFrame, column: str) -> DataFrame:
    """(vec_id, vector: components as little-endian f64, null if the row cannot link)."""

    def run(batches):
        for b in batches:
            rows = []
            for v in b.column(1):
                values = v.values if v.is_valid else None
                if values is None or not len(values) or values.null_count:
                    rows.append(None)
                    continue
                x = values.to_numpy(zero_copy_only=False).astype("<f8")
                x += 0.0  # one zero
                rows.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield batch(_CLEAN, b.column(0).cast(pa.int64()), rows)

    return arrow_map(embeddings.select("vec_id", column), run, "vec_id long, vector binary")


_TILE = pa.schema([("t", pa.int64()), ("path", pa.string())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def write_tiles(classes: DataFrame, tiles: int) -> DataFrame:
    """(t, path): the classes dealt into files of about equal numbers, in the shared folder."""
    folder = shared_dir(classes.sparkSession)

    def write(table: pa.Table) -> pa.Table:
        t, raw = table["t"][0].as_py(), table["vector"].to_pylist()
        size = np.array([len(v) // 8 for v in raw])
        path = write_arrays(folder, f"tile-{t}", node=table["node"].to_numpy(), w=table["w"].to_numpy(), size=size, data=np.frombuffer(b"".join(raw), "<f8"))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(([t], [path]), _TILE)], schema=_TILE)

    t = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(tiles)).cast("long")
    return settle(classes.select(t.alias("t"), "node", "w", "vector").groupBy("t").applyInArrow(write, "t long, path string"), "tiles")


def of_length(tile: dict[str, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, weights and vectors of a tile's classes of this length."""
    at = tile["size"] == dim
    cells = np.repeat(at, tile["size"])
    return tile["node"][at], tile["w"][at], tile["data"][cells].reshape(-1, dim)


def compare(left: dict[str, np.ndarray], right: dict[str, np.ndarray], threshold: float, same: bool) -> pa.RecordBatch:
    """Sums of links (a, null, n) of both tiles' nodes, and edges (a, b, 0) of a forest that spans what is linked."""
    a, b, n = [], [], []
    for dim in np.intersect1d(left["size"], right["size"]):
        mine, wx, x = of_length(left, dim)
        theirs, wy, y = (mine, wx, x) if same else of_length(right, dim)
        cx, cy, root = tile_links(x, wx, y, wy, threshold, same)
        nodes = mine if same else np.concatenate([mine, theirs])
        for ids, c in ((mine, cx), (theirs, cy)):
            a += ids[c > 0].tolist()
            n += c[c > 0].tolist()
        b += [None] * (len(a) - len(b))
        moved = np.flatnonzero(root != np.arange(len(root)))
        a += nodes[moved].tolist()
        b += nodes[root[moved]].tolist()
        n += [0] * len(moved)
    return batch(_FOUND, a, b, n)


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, column: str = "embedding", tile: int = TILE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row a vector."""
    vectors = settle(clean_vectors(embeddings, column).withColumn("name", F.md5("vector")), "vectors")
    classes = vectors.where("vector is not null").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("vector").alias("vector"))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    tiles = max(1, -(-classes.count() // tile))
    files = write_tiles(classes, tiles)
    pairs = files.select(F.col("t").alias("i"), F.col("path").alias("left"), F.explode(F.sequence("t", F.lit(tiles - 1).cast("long"))).alias("t")).join(files, "t")
    pairs = settle(pairs.select("i", F.col("t").alias("j"), "left", F.col("path").alias("right")), "pairs")

    def run(batches):
        for found in batches:
            for left, right in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
                one = read_arrays(left)
                yield compare(one, one if left == right else read_arrays(right), threshold, left == right)

    tasks = pairs.repartitionByRange(max(1, min(pairs.count(), MOST_TASKS)), "i", "j").select("left", "right")
    found = settle(arrow_map(tasks, run, "a long, b long, n long"), "found")
    links = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("n = 0").select("a", "b")).withColumnRenamed("component", "root")
    known = classes.select("name", "node", "rep", "w").join(links, "node", "left").join(roots, "node", "left")
    known = settle(known.select("name", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    least = settle(known.groupBy("root").agg(F.min("rep").alias("component")), "names")
    named = known.join(least, "root").select("name", "n_links", "component")
    got = vectors.select("vec_id", "name").join(settle(named, "named"), "name", "left")
    component = F.coalesce("component", "vec_id")
    return got.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
