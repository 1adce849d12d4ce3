"""What the queries without a DuckDB twin must hold: bounds of sketches, splits that lose nothing, known hashes."""

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from heronq.plans.catalog import ORACLES, QUERIES

CHECKED = {"sampling", "random_split", "approximate_distinct", "sketches", "sketch_union", "count_min", "sorted_partitions", "soundex", "hash_functions"}


@pytest.fixture
def read(spark, sf_dir):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


@pytest.fixture
def run(spark, sf_dir):
    return lambda name: QUERIES[name](spark, sf_dir)


def test_all_are_here():
    assert set(QUERIES) - set(ORACLES) == CHECKED


def test_sampling(run, read):
    """A tenth of all and a share of each status, each row of the table; the same on a second run."""
    orders = {r.o_orderkey: r.o_orderstatus for r in read("orders").collect()}
    got, again = ([r.o_orderkey for r in run("sampling").collect()] for _ in range(2))
    assert set(got) <= set(orders) and sorted(got) == sorted(again)
    kinds = Counter(orders.values())
    want = 0.1 * len(orders) + 0.05 * kinds["F"] + 0.5 * kinds["P"]
    assert abs(len(got) - want) < 6 * math.sqrt(want)
    assert max(Counter(got).values()) <= 2


def test_random_split(run, read):
    got = run("random_split").collect()
    assert sorted(r.c_custkey for r in got) == sorted(r.c_custkey for r in read("customer").collect())
    share = sum(r.part == "train" for r in got) / len(got)
    assert abs(share - 0.8) < 6 * math.sqrt(0.16 / len(got))


def test_approximate_distinct(run, read):
    exact = {r.l_returnflag: r.n for r in read("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n")).collect()}
    got = {r.l_returnflag: r.parts for r in run("approximate_distinct").collect()}
    assert set(got) == set(exact)
    assert all(abs(got[k] - n) <= 0.06 * n + 1 for k, n in exact.items())


def test_sketches(run, read):
    rows = {}
    for r in read("events").collect():
        rows.setdefault(r.event_type, []).append((r.user_id, r.value))
    got = run("sketches").collect()
    assert {r.event_type for r in got} == set(rows)
    for r in got:
        users, values = {u for u, _ in rows[r.event_type]}, sorted(v for _, v in rows[r.event_type])
        assert abs(r.users - len(users)) <= 0.07 * len(users) + 1
        for q, v in ((0.5, r.p50), (0.99, r.p99)):
            rank = sum(x <= v for x in values)
            assert v in values and abs(rank - q * len(values)) <= 0.001 * len(values) + values.count(v)


def test_sketch_union(run, read):
    users = read("events").select("user_id").distinct().count()
    (got,) = run("sketch_union").collect()
    assert abs(got.users - users) <= 0.07 * users + 1 and abs(got.theta_users - users) <= 0.07 * users + 1


def test_count_min(spark, run, read):
    """Estimates are never below the count, and above it by a thousandth of all rows at most."""
    exact = {}
    for r in read("events").collect():
        exact.setdefault(r.event_type, Counter())[r.user_id] += 1
    got = run("count_min").collect()
    assert {r.event_type for r in got} == set(exact)
    for r in got:
        sketch = spark._jvm.org.apache.spark.util.sketch.CountMinSketch.readFrom(bytearray(r.sketch))
        total = sum(exact[r.event_type].values())
        assert sketch.totalCount() == total
        over = [sketch.estimateCount(u) - n for u, n in exact[r.event_type].items()]
        assert min(over) >= 0 and sum(x > 0.001 * total for x in over) <= max(1, 0.01 * len(over))


def test_sorted_partitions(run, read):
    got = run("sorted_partitions").withColumn("at", F.spark_partition_id()).collect()
    assert sorted(r.o_orderkey for r in got) == sorted(r.o_orderkey for r in read("orders").collect())
    dates = {r.o_orderkey: r.o_orderdate for r in read("orders").collect()}
    owner, last = {}, {}
    for r in got:
        assert owner.setdefault(r.o_custkey, r.at) == r.at
        place = (r.o_custkey, dates[r.o_orderkey])
        assert last.get(r.at, place) <= place
        last[r.at] = place


def test_soundex(run):
    known = {"AFRICA": "A162", "AMERICA": "A562", "ASIA": "A200", "EUROPE": "E610", "MIDDLE EAST": "M342"}
    got = {r.r_name: r.sound for r in run("soundex").collect()}
    assert got == {k: known[k] for k in got} and len(got) == 5


def test_hash_functions(run):
    for r in run("hash_functions").collect():
        x = xxhash.xxh64(r.url.encode(), seed=42).intdigest()
        assert (r.crc, r.xx) == (zlib.crc32(r.url.encode()), x - (1 << 64) * (x >> 63))
