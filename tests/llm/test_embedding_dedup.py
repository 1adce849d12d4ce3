import numpy as np
import pytest
from pyspark.sql import types as T

from heronq.llm import embedding_dedup as E
from heronq.llm import queries


def brute(vectors, threshold):
    """{id: (n_links, component)} by comparing every pair in double precision; vectors: list of (id, list or None)."""
    good = [k for k, (_, v) in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(vectors))}
    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            a, b = np.array(vectors[i][1], float), np.array(vectors[j][1], float)
            if len(a) == len(b) and E.cosine(a[None], b[None])[0] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], set()
    for k in range(len(vectors)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((vectors[g][0] for g in group if vectors[g][0] is not None), default=vectors[k][0])
        out += [(vectors[g][0], len(links[g]), least) for g in group]
    return sorted(out, key=str)


def rows(df):
    got = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


@pytest.mark.parametrize("dim", [1, 3, 64, 1500])
def test_bounds_hold(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((60, dim)) * 10.0 ** rng.integers(-150, 150, (60, 1))
    unit, codes, scale, norm, error = E.quantise(x)
    exact = unit @ unit.T
    near = E.codes_product(codes, codes) * scale[:, None] * scale[None, :]
    assert (E.codes_product(codes, codes) == codes.astype(np.int64) @ codes.astype(np.int64).T).all()
    assert (np.abs(exact - near) <= error[:, None] * (norm + error)[None, :] + norm[:, None] * error[None, :] + 1e-12).all()


def test_tiles_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    vectors = [(int(k * 7 % 211), (base[k % 6] + 0.28 * rng.standard_normal(16)).tolist()) for k in range(200)]
    vectors += [(1000 + k, vectors[3][1]) for k in range(40)]  # copies
    vectors += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1e300] * 16), (2006, [1e-300] * 16), (2007, [1.0] * 8), (2008, [1.0] * 8), (2009, [float("inf")] * 16)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n_links", T.StringType()), T.StructField("component", T.IntegerType())])
    df = spark.createDataFrame([(*v, "x", 1) for v in vectors], schema)
    want = brute(vectors, 0.9)
    for tile in (50, 4096):
        assert rows(E.near_duplicates(df, 0.9, tile=tile)) == want
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_equal_and_null_ids(spark):
    """Rows are told apart whatever their ids; ids beyond 2^53 stay exact."""
    vectors = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (None, [1.0, 0.05]), (None, [-1.0, 0.0]), (None, [-1.0, 0.01]), (None, None), (3, None), (None, [0.5, 0.5])]
    vectors += [((1 << 60) + 1, [0.0, -1.0, 0.0]), ((1 << 60) + 3, [0.0, -1.0, 0.01]), (1, [0.0, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    for tile in (2, 4096):
        assert rows(E.near_duplicates(df, 0.9, tile=tile)) == brute(vectors, 0.9)


def test_op8_query(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert rows(queries.op8_embedding_dedup(spark, sf_dir)) == brute(vectors, 0.9)
