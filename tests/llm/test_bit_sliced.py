import numpy as np
import pytest

from heronq.llm import bit_sliced as B
from heronq.llm import queries


def brute(rows, k, scale=64, every=20):
    """{(query's place, query_id): [(vec_id, score)]} by comparing every pair in whole numbers."""
    codes = []
    for i, v in rows:
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        c = [int(np.floor(float(x) * scale)) if abs(float(x) * scale) < 1e300 else 1 << 62 for x in v]
        if all(abs(x) < 2**31 for x in c) and sum(x * x for x in c) < 2**63:
            codes.append((i, c))
    out = []
    for a, (i, x) in enumerate(codes):
        if i is None or i % every:
            continue
        found = [(-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(codes) if b != a and len(y) == len(x)]
        out += [(i, r + 1, None if unknown else j, -s) for r, (s, unknown, j) in enumerate(sorted(found)[:k])]
    return sorted(out, key=lambda r: (r[0], r[1], r[3], r[2] or 0))


def got(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()), key=lambda r: (r[0], r[1], r[3], r[2] or 0))


@pytest.mark.parametrize("n,dim,most", [(1000, 64, 30), (70, 3, 1 << 30), (128, 1, 5), (65, 0, 1), (500, 16, 1), (64, 9, 0), (1, 4, 3)])
def test_slices_add_up_and_select(n, dim, most):
    rng = np.random.default_rng(n)
    x = rng.integers(-most, most + 1, (n, dim))
    block = B.slice_block(x)
    for q in (*rng.integers(-most, most + 1, (5, dim)), np.zeros(dim, np.int64), np.full(dim, most), np.full(dim, -most)):
        at, power, minus = B.signed_digits(q)
        assert [sum(int(1 - 2 * m) << int(p) for a, p, m in zip(at, power, minus) if a == d) for d in range(dim)] == q.tolist()
        sums, constant = B.add_slices(q, block["low"], block["first"], block["slices"].reshape(len(block["slices"]), -(-n // 64)))
        want = [sum(int(a) * int(b) for a, b in zip(row, q)) for row in x]
        assert [B.sum_at(sums, r) + constant for r in range(n)] == want
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[:n] = rng.integers(0, 2, n)
        exists = np.packbits(bits, bitorder="little").view(np.uint64)
        for k in (1, 7, n):
            order = sorted((-want[r], r) for r in np.flatnonzero(bits))[:k]
            assert sorted(B.best_rows(sums, exists, k).tolist()) == sorted(r for _, r in order)


def vectors(rng):
    base = rng.standard_normal((8, 12)) / 3
    rows = [(int(i), (base[i % 8] + 0.05 * rng.standard_normal(12)).tolist()) for i in rng.permutation(300)]
    rows += [(400 + i, base[0].tolist()) for i in range(90)]  # ties far beyond k
    rows += [(20, rows[0][1]), (20, rows[0][1]), (40, None), (60, []), (None, base[0].tolist()), (None, None), (100, []), (7, [])]
    rows += [(500, [float("nan")] * 12), (520, [None] + [1.0] * 11), (540, [float("inf")] * 12), (560, [1e300] * 12), (580, [2.0**25] * 12), (600, [2.0**24] * 12), (620, [-(2.0**24)] * 12), (640, [0.0] * 12)]
    return rows + [(660, [1.0, -1.0]), (680, [0.5]), (700, [0.25, 9.0]), (701, [-0.001, 1e-9])]


def test_against_brute_force(spark):
    rows = vectors(np.random.default_rng(3))
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<double>, score int, rank string, part int")
    want = brute(rows, 20)
    assert got(B.top_k(df, 20)) == want
    assert got(B.top_k(df, 20, cells=1000, queries=3, span=2)) == want
    assert got(B.top_k(df, 3, cells=1, queries=9, span=4)) == brute(rows, 3)
    assert B.top_k(df.limit(0), 20).count() == 0
    assert B.top_k(df.where("vec_id = 20").limit(1), 20).count() == 0


def test_op11_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(queries.op11_bit_sliced_search(spark, sf_dir)) == brute(rows, 20)
