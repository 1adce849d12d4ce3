"""What the stream queries must show beyond equality with batch SQL."""

import datetime

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heronq.plans import streams
from heronq.plans.catalog import ORACLES, QUERIES
from heronq.plans.streams import rocksdb
from heronq.streaming import replay as R

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def test_provider_is_restored(spark):
    before = spark.conf.get(PROVIDER)
    with rocksdb(spark):
        assert "RocksDB" in spark.conf.get(PROVIDER)
    assert spark.conf.get(PROVIDER) == before
    spark.conf.set(PROVIDER, "x")
    with rocksdb(spark):
        pass
    assert spark.conf.get(PROVIDER) == "x"
    spark.conf.unset(PROVIDER)


def test_expired_keys_come_through_again(spark, sf_dir):
    """Not plain DISTINCT: some keys are told twice, none in each slice, as its state outlives the next slice."""
    times = [r.times for r in QUERIES["stream_dedup_expiring"](spark, sf_dir).collect()]
    assert len(times) == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type").distinct().count()
    assert 2 <= max(times) <= 3


def test_open_visits_are_held_back(spark, sf_dir):
    got = QUERIES["stream_visits"](spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    told = got.agg({"n": "sum"}).head()[0]
    assert 0 < told < events and got.where("kinds > n or last_us < start_us").count() == 0


def test_slices_of_several_files_are_one_batch_each(spark, monkeypatch):
    monkeypatch.setattr(R, "FILE_ROWS", 20)
    start = datetime.datetime(2024, 1, 1)
    seconds = [s for s in range(600) if not 200 <= s < 300 and (s < 500 or s % 9 == 5)]  # the third slice is empty
    events = spark.createDataFrame([(s, start + datetime.timedelta(seconds=s)) for s in seconds], "s long, ts timestamp")
    seen = []
    stream = R.replay(spark, events, order=(0, 1, 2, 4, 5, 3)).withColumn("file", F.input_file_name())
    rows = R.run_to_table(stream, "update").collect()
    assert sorted(r.s for r in rows) == seconds
    for r in rows:
        seen.append((r._batch, r.s // 100, r.file))
    assert {(b, k) for b, k, _ in seen} == {(0, 0), (1, 1), (3, 4), (4, 5), (5, 3)}
    assert len({f for b, _, f in seen if b == 0}) == 4


@pytest.mark.parametrize("name", ["stream_visits", "stream_state", "stream_state_legacy"])
def test_state_over_odd_rows(spark, tmp_path, name, monkeypatch):
    """Null users, kinds and values, and visits over the edges of slices, in few and many buckets; each bucket is one key of state."""
    monkeypatch.setattr(streams, "FEW_ROWS", 100)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=7 * i, microseconds=i), None if i % 11 == 0 else i * i % 13, None if i % 5 == 0 else "ab"[i % 2], None if i % 13 in (4, 10) else i / 4) for i in range(700)]
    rows += [(start + datetime.timedelta(hours=13 * i, minutes=1), 10**15 + 1 + i % 2, None, None) for i in range(6)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    users = spark.range(20_000).withColumnRenamed("id", "user_id")
    assert streams.by_bucket(users, users).count().count() <= 200


@pytest.mark.parametrize("name", ["stream_state", "stream_state_legacy"])
def test_state_is_not_kept_by_single_users(spark, sf_dir, name, monkeypatch):
    seen = []
    monkeypatch.setattr(streams, "run_to_table", lambda df, mode: seen.append(df.columns) or R.run_to_table(df, mode))
    QUERIES[name](spark, sf_dir)
    assert "bucket" in seen[0]


class Held:
    """State that counts the exchanges with it."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self if name == "visits" else Held()

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_batch_of_visits_takes_few_exchanges():
    calls = []
    for n in (100, 1000):
        held, visits = Held(), streams.Visits(1000)
        visits.init(held)
        frame = pd.DataFrame({"user_id": [i % 10 for i in range(n)], "us": [i * 200 for i in range(n)], "event_type": "x"})
        (told,) = visits.handleInputRows((0,), iter([frame]), None)
        calls.append(held.calls)
        assert len(told) == n - 10 and len(held.rows) == 10 and held.timers == [-(-((n - 10) * 200 + 1000) // 1000)]
    assert calls[0] == calls[1] <= 3
