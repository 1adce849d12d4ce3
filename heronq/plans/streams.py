"""Streaming queries, run to the end of a replayed table."""

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heronq.plans.catalog import query
from heronq.sources.scratch import scratch
from heronq.streaming.replay import JsonLines, replay, run_to_table

DAYS = "SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1"


def _start(c="window.start"):
    return F.col(c).cast("timestamp_ntz")


@query(DAYS)
def stream_tumbling_complete(t):
    counts = replay(t.spark, t.events).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run_to_table(counts.select(_start().alias("day"), "n"), "complete")


@query(f"SELECT * FROM ({DAYS}) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling_append(t):
    """Windows that the watermark has closed; the last ones stay open."""
    counts = replay(t.spark, t.events).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run_to_table(counts.select(_start().alias("day"), "n"))


@query("""
WITH e AS (SELECT ts, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), b AS (SELECT min(s) AS lo, max(s) + 1 - min(s) AS span FROM e)
SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS day, count(*) AS n FROM e, b WHERE NOT (s >= lo + span * 3 // 6 AND s < lo + span * 4 // 6)
GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_late_rows(t):
    """The fourth of six slices comes last, when the watermark of the fifth has closed its windows: its rows are dropped."""
    counts = replay(t.spark, t.events, order=(0, 1, 2, 4, 5, 3)).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return run_to_table(counts.select(_start().alias("day"), "n"))


@query("""
SELECT start::TIMESTAMP AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) GROUP BY start""")
def stream_sliding_complete(t):
    counts = replay(t.spark, t.events).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return run_to_table(counts.select(_start().alias("start"), "n"), "complete")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
e AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, start::TIMESTAMP AS start, n FROM e WHERE stop <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(t):
    counts = replay(t.spark, t.events).withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return run_to_table(counts.select("user_id", _start("session_window.start").alias("start"), "n"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    rows = replay(t.spark, t.events).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_table(rows.select("user_id", "event_type"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 1")
def stream_filter(t):
    return run_to_table(replay(t.spark, t.events).where("event_type = 'error' AND value > 1").select("event_id", "user_id"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 1")
def stream_to_table(t):
    where = scratch(t.spark)
    rows = replay(t.spark, t.events).where("event_type = 'error' AND value > 1").select("event_id", "user_id")
    name = f"heronq_stream_{uuid.uuid4().hex[:8]}"
    rows.writeStream.option("checkpointLocation", f"{where}/state").option("path", f"{where}/out").trigger(availableNow=True).toTable(name).awaitTermination()
    return t.spark.table(name)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND value > 1")
def stream_foreach(t):
    """A writer of one's own: a file for each partition and batch, which a repeated attempt replaces as a whole."""
    where = scratch(t.spark)
    rows = replay(t.spark, t.events).where("event_type = 'error' AND value > 1").select("event_id", "user_id")
    rows.writeStream.option("checkpointLocation", f"{where}/state").foreach(JsonLines(f"{where}/out")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).json(f"{where}/out")


@query(DAYS)
def stream_memory(t):
    """The memory sink keeps its rows on the driver: here one a day."""
    counts = replay(t.spark, t.events).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(_start().alias("day"), "n")
    name = f"heronq_memory_{uuid.uuid4().hex[:8]}"
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch(t.spark)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.table(name)


@query("""
SELECT p.event_id AS purchase, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.ts <= p.ts AND v.ts >= p.ts - INTERVAL 2 HOUR
WHERE p.event_type = 'purchase' AND v.event_type = 'view'""")
def stream_stream_join(t):
    p = replay(t.spark, t.events.where("event_type = 'purchase'")).select("user_id", F.col("ts").alias("pt"), F.col("event_id").alias("purchase")).withWatermark("pt", "6 days")
    v = replay(t.spark, t.events.where("event_type = 'view'")).select(F.col("user_id").alias("vu"), F.col("ts").alias("vt"), F.col("event_id").alias("view_id")).withWatermark("vt", "6 days")
    joined = p.join(v, F.expr("user_id = vu AND vt <= pt AND vt >= pt - INTERVAL 2 HOURS"))
    return run_to_table(joined.select("purchase", "view_id"))


#: Rows of a bucket of users: at most that many buckets for fewer, and at least that many for more.
FEW_ROWS, MANY_ROWS = 2_000, 20_000


def by_bucket(rows, events):
    """Stream rows grouped by buckets of users, each a key of state. A call of Python and an exchange with the state store are
    so made for hundreds of users at once; the buckets grow in number with the table. Null users have the bucket -1, as user 0."""
    n, parts = events.count(), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(2 * parts, n // FEW_ROWS), n // MANY_ROWS)
    bucket = F.when(F.col("user_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(count)))
    return rows.withColumns({"bucket": bucket.cast("long"), "user_id": F.coalesce("user_id", F.lit(0).cast("long"))}).groupBy("bucket")


def _user():
    return F.when(F.col("bucket") >= 0, F.col("user_id")).alias("user_id")


@query("SELECT user_id, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY user_id")
def stream_state_legacy(t):
    """Counts kept by applyInPandasWithState; of its updates the last of each user counts."""

    def step(key, frames, state: GroupState):
        new = pd.concat([f.groupby("user_id").us.agg(["size", "max"]) for f in frames]).groupby(level=0).agg({"size": "sum", "max": "max"})
        users, ns, lasts = state.get if state.exists else ([], [], [])
        old = pd.DataFrame({"size": ns, "max": lasts}, index=pd.Index(users, dtype="int64"), dtype="int64")
        now = pd.concat([old, new]).groupby(level=0).agg({"size": "sum", "max": "max"})
        state.update((now.index.tolist(), now["size"].tolist(), now["max"].tolist()))
        told = now.loc[new.index]
        yield pd.DataFrame({"bucket": key[0], "user_id": told.index.to_numpy(), "n": told["size"].to_numpy(), "last": told["max"].to_numpy()})

    rows = replay(t.spark, t.events.select("user_id", "ts")).select("user_id", F.unix_micros("ts").alias("us"))
    out = by_bucket(rows, t.events).applyInPandasWithState(step, "bucket long, user_id long, n long, last long", "users array<long>, n array<long>, last array<long>", "update", GroupStateTimeout.NoTimeout)
    return run_to_table(out, "update").groupBy(_user()).agg(F.max("n").alias("n"), F.max("last").alias("last"))


class Totals(StatefulProcessor):
    """Running count and sum by user, for a bucket of users at once."""

    COLUMNS = ["user_id", "n", "valued", "cents"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("totals", "user_id long, n long, valued long, cents long")

    def handleInputRows(self, key, rows, timerValues):
        old = pd.DataFrame(list(self.state.get()) if self.state.exists() else [], columns=self.COLUMNS, dtype="int64")
        new = pd.concat([f.assign(n=1)[self.COLUMNS].groupby("user_id", as_index=False).sum() for f in rows])
        now = pd.concat([old, new]).groupby("user_id", as_index=False).sum()
        self.state.put([tuple(r) for r in now[self.COLUMNS].to_numpy().tolist()])
        told = now[now.user_id.isin(new.user_id)]
        yield told.assign(bucket=key[0])[["bucket", *self.COLUMNS]]

    def close(self) -> None:
        pass


@query("SELECT user_id, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY user_id")
def stream_state(t):
    cents = F.round(F.col("value") * 100).cast("long")
    rows = replay(t.spark, t.events.select("user_id", "ts", "value"))
    rows = rows.select("user_id", F.col("value").isNotNull().cast("long").alias("valued"), F.coalesce(cents, F.lit(0).cast("long")).alias("cents"))
    out = by_bucket(rows, t.events).transformWithStateInPandas(Totals(), "bucket long, user_id long, n long, valued long, cents long", "Update", "None")
    with rocksdb(t.spark):
        got = run_to_table(out, "update")
    return got.groupBy(_user()).agg(F.max("n").alias("n"), F.max_by(F.when(F.col("valued") > 0, F.col("cents")), "n").alias("cents"))


@contextmanager
def rocksdb(spark):
    """State in RocksDB, which timers and several state variables need, for the streams run inside; then as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


class Visits(StatefulProcessor):
    """The visits of a bucket of users: events less than `gap` microseconds apart. A visit is told when a later event begins another, or
    when the watermark passes its end, for which the bucket has a timer; with it goes its state. Null kinds are not counted."""

    VISIT, KIND = ["user_id", "start", "last", "n"], ["user_id", "kind"]

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.visits = handle.getListState("visits", "user_id long, start long, last long, n long")
        self.kinds = handle.getListState("kinds", "user_id long, kind string")

    def known(self):
        visits, kinds = (list(x.get()) if x.exists() else [] for x in (self.visits, self.kinds))
        return pd.DataFrame(visits, columns=self.VISIT, dtype="int64"), pd.DataFrame(kinds, columns=self.KIND).astype({"user_id": "int64"})

    def keep(self, visits, kinds) -> None:
        """Puts the open visits, with a timer at the end of the first; timers of visits that went on find nothing to tell."""
        for state, rows in ((self.visits, visits[self.VISIT]), (self.kinds, kinds[self.KIND])):
            if len(rows):
                state.put(list(zip(*(rows[c].tolist() for c in rows))))
            else:
                state.clear()
        if len(visits):
            self.handle.registerTimer(int(self.due(visits["last"]).min()))

    def due(self, last):
        """The millisecond by which no event can extend the visit."""
        return -(-(last + self.gap) // 1000)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([f[["user_id", "us", "event_type"]] for f in rows]).sort_values(["user_id", "us"], ignore_index=True)
        visits, kinds = self.known()
        before = new.groupby("user_id").us.shift().fillna(-1).astype("int64")
        first = ~new.user_id.duplicated()
        last = new.user_id.map(visits.set_index("user_id")["last"])
        goes_on = first & last.notna() & (new.us - last.fillna(0).astype("int64") < self.gap)
        # v numbers visits: a user's open visit, told or going on, is its own row of parts
        new["v"] = ((first & ~goes_on) | (~first & (new.us - before >= self.gap)) | goes_on).cumsum()
        on = new.loc[goes_on, ["user_id", "v"]].set_index("user_id").v
        numbers = pd.Series(-1 - visits.index.to_numpy(), index=visits.user_id, dtype="int64")
        numbers.update(on)
        parts = pd.concat([visits.assign(v=visits.user_id.map(numbers)), pd.DataFrame({"user_id": new.user_id, "start": new.us, "last": new.us, "n": 1, "v": new.v})])
        every = parts.groupby("v", as_index=False).agg({"user_id": "first", "start": "min", "last": "max", "n": "sum"})
        seen = pd.concat([kinds.assign(v=kinds.user_id.map(numbers)), new.dropna(subset="event_type").rename(columns={"event_type": "kind"})[["user_id", "kind", "v"]]]).drop_duplicates(["v", "kind"])
        is_open = ~every.sort_values("v").user_id.duplicated(keep="last")
        self.keep(every[is_open], seen[seen.v.isin(every.v[is_open])])
        yield self.table(key, every[~is_open], seen.groupby("v").size())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        visits, kinds = self.known()
        over = self.due(visits["last"]) <= timerValues.getCurrentWatermarkInMs()
        left = visits[~over]
        self.keep(left, kinds[kinds.user_id.isin(left.user_id)])
        yield self.table(key, visits[over].assign(v=visits.user_id[over]), kinds.groupby("user_id").size())

    def table(self, key, told, counts):
        kinds = told.v.map(counts).fillna(0)
        return pd.DataFrame({"bucket": key[0], "user_id": told.user_id, "start_us": told["start"], "last_us": told["last"], "n": told.n, "kinds": kinds}).astype("int64")

    def close(self) -> None:
        pass


@query("""
WITH g AS (SELECT user_id, event_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS k FROM g),
v AS (SELECT user_id, min(us) AS start_us, max(us) AS last_us, count(*) AS n, count(DISTINCT event_type) AS kinds, k, max(k) OVER (PARTITION BY user_id) AS ks FROM s GROUP BY user_id, k)
SELECT user_id, start_us, last_us, n, kinds FROM v WHERE k < ks OR last_us + 3600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def stream_visits(t):
    """Visits by event-time timers and two kinds of state; what the last watermark has not passed is not told."""
    rows = replay(t.spark, t.events.select("user_id", "event_type", "ts")).withWatermark("ts", "1 hour").select("user_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    out = by_bucket(rows, t.events).transformWithStateInPandas(Visits(3_600_000_000), "bucket long, user_id long, start_us long, last_us long, n long, kinds long", "Append", "EventTime")
    with rocksdb(t.spark):
        return run_to_table(out).select(_user(), "start_us", "last_us", "n", "kinds")


@query("""
WITH RECURSIVE e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), b AS (SELECT min(s) AS lo, max(s) + 1 - min(s) AS span FROM e),
f AS (SELECT user_id, event_type, ts, (SELECT count(*) FROM range(1, 6) x(j) WHERE s >= lo + span * j // 6) AS k FROM e, b),
firsts AS (SELECT user_id, event_type, k, min(ts) AS t FROM f GROUP BY ALL),
marks AS (SELECT k + 1 AS k, max(max(t)) OVER (ORDER BY k) - INTERVAL 2 DAY AS mark FROM firsts GROUP BY k),
gone AS (SELECT f.*, coalesce((SELECT min(m.k) FROM marks m WHERE m.mark >= f.t + INTERVAL 2 DAY), 99) AS e FROM firsts f),
told(user_id, event_type, k, e) AS (SELECT user_id, event_type, k, e FROM gone QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY k) = 1
  UNION ALL SELECT user_id, event_type, k, e FROM (SELECT g.*, row_number() OVER (PARTITION BY g.user_id, g.event_type ORDER BY g.k) AS i FROM told p JOIN gone g ON g.user_id = p.user_id AND g.event_type = p.event_type AND g.k > p.e) WHERE i = 1)
SELECT user_id, event_type, count(*) AS times FROM told GROUP BY user_id, event_type""")
def stream_dedup_expiring(t):
    """A key comes through again once the watermark has passed the time until which its first row is remembered."""
    e = t.events.withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    lo, hi = e.agg(F.min("s"), F.max("s")).head()
    k = F.lit(0)
    for j in range(1, 6) if lo is not None else ():
        k = k + (F.col("s") >= lo + (hi + 1 - lo) * j // 6).cast("int")
    firsts = e.groupBy("user_id", "event_type", k.alias("k")).agg(F.min("ts").alias("ts"))
    rows = replay(t.spark, firsts, bounds=None if lo is None else (lo, hi)).withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_table(rows.select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count("*").alias("times"))
