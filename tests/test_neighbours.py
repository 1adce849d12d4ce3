"""Exact neighbours against all pairs, on clustered vectors where strips are skipped and on ties."""

import numpy as np
import pytest

from heronq.operators import neighbours as N


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, x) in enumerate(good):
        if i is None or i % 20:
            continue
        near = [(-round(float((x / np.linalg.norm(x)) @ (y / np.linalg.norm(y))), N.PLACES), j is None, j or 0) for b, (j, y) in enumerate(good) if b != a and len(y) == len(x)]
        out += [(i, r + 1, None if unknown else j, -c) for r, (c, unknown, j) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.cosine, N.PLACES)) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [16 << 20, 400])
def test_against_all_pairs(spark, chunk, monkeypatch):
    monkeypatch.setattr(N, "STRIP", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((6, 8))
    rows = [(int(i), (base[i % 6] + 0.05 * rng.standard_normal(8)).tolist()) for i in rng.permutation(240)]
    rows += [(300 + i, base[1].tolist()) for i in range(40)] + [(20, base[2].tolist()), (20, base[2].tolist()), (None, base[1].tolist())]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [float("nan")] * 8), (480, [None] + [1.0] * 7), (500, [1.0, 2.0]), (501, [2.0, 1.0]), (520, [5.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, row int, unit string")
    assert got(N.exact_neighbours(df, 10, chunk_bytes=chunk)) == brute(rows, 10)
    assert N.exact_neighbours(df.limit(0)).count() == 0


def test_strips_are_skipped():
    """Tight clusters: most strips cannot hold a neighbour, and the answer does not change."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = rng.standard_normal((8, 16))
    x = np.repeat(base, 100, axis=0) + 0.01 * rng.standard_normal((800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = base / np.linalg.norm(base, axis=1, keepdims=True)
    skipped, real = [], np.round

    def seen(a, *rest):
        skipped.append(len(a))
        return real(a, *rest)

    N.np.round = seen
    try:
        old, N.STRIP = N.STRIP, 100
        batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(range(800)), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "vec_id", "unit"])
        (out,) = N.pass_over([batch], (np.arange(0, 800, 20), np.arange(0, 800, 20), x[::20]), pivots, 5)
    finally:
        N.np.round, N.STRIP = real, old
    assert sum(skipped) < 0.7 * 8 * 40
    want = np.argsort(-(x[::20] @ x.T), axis=1)[:, 1:6] // 100
    assert out.num_rows == 200 and (np.sort(out.column(2).to_numpy() // 100) == np.sort(want.ravel())).all()


def test_memory_of_a_task_does_not_grow_with_its_queries():
    """Arrays that a task makes beside its queries and their k rows are bounded by a block of them."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    y = rng.standard_normal((1500, 8))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(range(1500)), pa.array([v.tobytes() for v in y], pa.binary())], names=["row", "vec_id", "unit"])
    peaks = []
    for times in (1, 6):
        asked = np.arange(10_000, 10_000 + 1000 * times), np.arange(1000 * times), np.tile(y[:1000], (times, 1))
        tracemalloc.start()
        out = pa.Table.from_batches(N.pass_over([batch], asked, y[:4], 3))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert out.num_rows == 3000 * times
    assert peaks[1] < 1.5 * peaks[0], peaks
