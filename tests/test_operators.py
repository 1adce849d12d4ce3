"""Operators on small tables with nulls, ties, repeats, empty sides and keys that are hot."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heronq.operators.frames import top_per_group
from heronq.operators.joining import join_small, salted_aggregate, salted_join
from heronq.operators.timeline import asof_join, range_join, sessionize

AT = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, strict):
    left = spark.createDataFrame([("a", AT(10), 1), ("a", AT(20), 2), ("a", AT(5), 3), ("b", AT(9), 4), (None, AT(9), 5), ("a", AT(20), 2)], "k string, ts timestamp, id int")
    right = spark.createDataFrame([("a", AT(10), 100), ("a", AT(10), 101), ("a", AT(19), 102), ("b", AT(10), 103), (None, AT(1), 104)], "k string, ts timestamp, v int")
    got = sorted((r.id, r.v) for r in asof_join(left, right, ["k"], "ts", ["v"], strict).collect())
    assert got == [(1, None if strict else 101), (2, 102), (2, 102), (3, None), (4, None), (5, None)]
    assert asof_join(left, right.limit(0), ["k"], "ts", ["v"]).where("v is not null").count() == 0
    assert asof_join(left.limit(0), right, ["k"], "ts", ["v"]).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "double"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_over_many_slices(spark, strict, kind):
    """A hot key over slices of which some are empty on one side, ties, null times and a slice's edge, against a plain search."""
    left = [(k, t) for k in ("a", "b", None) for t in (0, 9, 10, 11, 25, 47, 47, 95, None)]
    right = [("a", 9, 1), ("a", 10, 2), ("a", 10, 3), ("a", 40, 4), ("a", None, 5), ("b", 96, 6), ("b", 20, None), (None, 0, 7)]

    def table(rows, names):
        df = spark.createDataFrame(rows, f"k string, s int{names}")
        return df.withColumn("s", F.col("s").cast("double") if kind == "double" else F.timestamp_seconds("s").cast(kind))

    got = asof_join(table(left, "").withColumn("id", F.col("s").cast("string")), table(right, ", v int"), ["k"], "s", ["v"], strict, width=10)

    def match(k, t):
        before = [(s, v if v is not None else -1) for key, s, v in right if key == k and k is not None and None not in (s, t) and (s < t if strict else s <= t)]
        v = max(before)[1] if before else None
        return None if v == -1 else v

    ids = {r.s: r.id for r in table([(None, t) for _, t in left], "").withColumn("id", F.col("s").cast("string")).collect()}
    by_id = {ids[r.s]: t for r, (_, t) in zip(table([(None, t) for _, t in left], "").collect(), left)}
    assert sorted((str(r.k), str(by_id[r.id]), str(r.v)) for r in got.collect()) == sorted((str(k), str(t), str(match(k, t))) for k, t in left)


def test_sessions_over_many_slices(spark):
    times = [0, 5, 9, 10, 14, 31, 33, 60, 60, 95, 99, 104, 500]
    df = spark.createDataFrame([(k, AT(t), t) for k in ("u", None) for t in times] + [("v", None, -1), ("v", AT(3), 3)], "k string, ts timestamp, slice int")
    session, want = 0, []
    for i, t in enumerate(times):
        session += i == 0 or t - times[i - 1] > 10
        want += [("None", t, session), ("u", t, session)]
    want += [("v", -1, 1), ("v", 3, 2)]
    for width in (7, 10, 86_400):
        assert sorted((str(r.k), r.slice, r.session) for r in sessionize(df, "k", "ts", 10, width).collect()) == sorted(want)


def test_range_join(spark):
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate([-7.5, -4, 0, 3.99, 4, 11, 12])] + [(99, None)], "id int, x double")
    spans = spark.createDataFrame([(0, -8.0, -4.0), (1, 0.0, 4.0), (2, 4.0, 4.0), (3, -100.0, 12.0), (4, None, 1.0), (5, -1e9, 1e9)], "sid int, lo double, hi double")
    got = sorted((r.id, r.sid) for r in range_join(points, spans, "x", "lo", "hi", 4.0).collect())
    want = sorted((p.id, s.sid) for p in points.collect() for s in spans.collect() if None not in (p.x, s.lo, s.hi) and s.lo <= p.x < s.hi)
    assert got == want


def test_sessions(spark):
    e = spark.createDataFrame([("u", AT(0)), ("u", AT(60)), ("u", AT(121)), ("v", AT(0)), (None, AT(3))], "k string, ts timestamp")
    assert sorted((r.k or "", r.ts.second, r.session) for r in sessionize(e, "k", "ts", 60).collect()) == [("", 3, 1), ("u", 0, 1), ("u", 0, 1), ("u", 1, 2), ("v", 0, 1)]


def test_top_per_group_with_and_without_ties(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")], "k int, v int, n string")
    assert {r.n for r in top_per_group(df, ["k"], [F.desc("v")], 1).collect()} == {"a", "b", "d"}
    assert {r.n for r in top_per_group(df, ["k"], [F.desc("v"), "n"], 1, ties=False).collect()} == {"a", "d"}


def test_joins_agree_whatever_the_strategy(spark):
    left = spark.createDataFrame([(i % 3 if i % 7 else 0, i) for i in range(200)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (1, "z"), (9, "w"), (None, "n")], "k int, w string")
    want = sorted((r.k, r.v, r.w) for r in left.join(right, "k").collect())
    for got in (salted_join(left, right, ["k"], 5), join_small(left, right, "k"), join_small(left, right, "k", max_bytes=0)):
        assert sorted((r.k, r.v, r.w) for r in got.collect()) == want


def test_salted_aggregate(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 0, id % 5) AS k", "id AS v")
    got = salted_aggregate(df, ["k"], 7, {"s": F.sum("v")}, {"s": F.sum("s")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("k").agg(F.sum("v")).collect()))
