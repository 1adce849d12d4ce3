"""Joins and groupings along time that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Seconds (or units of a numeric time) that the rows of a key are split by, so that no task holds all rows of a hot key.
SLICE = 86_400


def _slice(df: DataFrame, time: str, width: float):
    """The number of the slice of time that a row lies in; it never falls as time grows."""
    t, kind = F.col(time), df.schema[time].dataType.typeName()
    if kind == "timestamp":
        at = F.unix_micros(t) / 1_000_000
    elif kind == "timestamp_ntz":  # by its fields, for a cast to a zoned timestamp goes back where clocks do
        at = F.unix_date(t.cast("date")) * F.lit(86_400) + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    elif kind == "date":
        at = F.unix_date(t) * F.lit(86_400)
    else:
        at = t
    return F.floor(at / F.lit(float(width))).cast("long")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, columns: list[str], strict: bool = False, width: float = SLICE) -> DataFrame:
    """Each left row with the columns of the latest right row of its keys at or before its time (before it, if strict).

    Both sides are united, sorted by time within slices of a key, and the last right row is carried forward; the last of earlier slices
    comes in as a row of its own, one a slice, so a hot key's rows are shared out by time. Right rows that tie in time count in an order
    of their columns. Left rows without a match have nulls, as have those with a null key or time: null equals nothing, as in a join.
    """
    picked = F.struct(*columns)
    right = right.where(F.col(time).isNotNull())
    lrows = left.select(*keys, time, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(picked.alias("r")).schema["r"].dataType).alias("r"), F.lit(0 if strict else 1).alias("side"), _slice(left, time, width).alias("slice"))
    rrows = right.select(*keys, time, F.lit(None).cast(lrows.schema["l"].dataType).alias("l"), picked.alias("r"), F.lit(1 if strict else 0).alias("side"), _slice(right, time, width).alias("slice"))
    rows = lrows.unionByName(rrows)
    newest = rows.groupBy(*keys, "slice").agg(F.max(F.when(F.col("l").isNull(), F.struct(time, "r"))).alias("x"))
    before = F.last("x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = newest.withColumn("x", before).where("x IS NOT NULL").select(*keys, F.col(f"x.{time}").alias(time), F.lit(None).cast(lrows.schema["l"].dataType).alias("l"), F.col("x.r").alias("r"), F.lit(0).alias("side"), "slice")
    whole = F.col(time).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    w = Window.partitionBy(*keys, "slice").orderBy(time, "side", "r").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.unionByName(carried).withColumn("m", F.when(whole, F.last("r", ignorenulls=True).over(w))).where("l IS NOT NULL")
    return found.select("l.*", *[F.col(f"m.{c}").alias(c) for c in columns])


#: Buckets that an interval touches at one level of range_join, but for one more; the next level's are so many times as wide.
SPREAD = 64


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with low <= at < high, by equal buckets, so the join is an equi-join.

    at is numeric. Buckets have the given width, for intervals wider than SPREAD of these SPREAD times that width, and so on: a right row is
    repeated SPREAD + 1 times at most, a left row once for each level that the widest interval needs. Intervals must be finite.
    """
    right = right.where(F.col(low) < F.col(high))
    level = F.greatest(F.lit(0), F.ceil(F.log(float(SPREAD), (F.col(high) - F.col(low)) / F.lit(float(width))))).cast("int")
    levels = (right.agg(F.max(level)).first()[0] or 0) + 1
    bucket = lambda c: F.floor(F.col(c) / (F.lit(float(width)) * F.pow(F.lit(float(SPREAD)), F.col("_level")))).cast("long")
    spread = right.withColumn("_level", level).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    points = left.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_bucket", bucket(at))
    return points.join(spread, [*keys, "_level", "_bucket"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_bucket")


def sessionize(events: DataFrame, key: str, time: str, gap_seconds: int, width: float = SLICE) -> DataFrame:
    """Adds session: 1, 2, ... by key, a new one after more than gap_seconds without a row.

    A key's rows are shared out by slices of time; from earlier slices only the newest time and the number of sessions are carried on.
    Null keys are one key; rows with a null time come first and each is a session.
    """
    names = [f"c{i}" for i in range(len(events.columns))]
    rows = events.withColumn("_slice", _slice(events, time, width)).toDF(*names, "slice")  # so that no column can clash with those used here
    k, at = names[events.columns.index(key)], names[events.columns.index(time)]
    by_slice = Window.partitionBy(k).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    newest = rows.groupBy(k, "slice").agg(F.max(at).alias("t")).withColumn("t", F.max("t").over(by_slice)).where("t IS NOT NULL")
    carried = newest.select(k, F.col("t").alias(at), "slice", F.lit(True).alias("old"))
    united = rows.withColumn("old", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    inside = Window.partitionBy(k, "slice").orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.when(F.col("old") | (seconds - F.lag(seconds).over(inside) <= gap_seconds * 1_000_000), 0).otherwise(1)
    begun = united.withColumn("new", new).withColumn("nth", F.sum("new").over(inside)).where("NOT old")
    totals = begun.groupBy(k, "slice").agg(F.sum("new").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(by_slice), F.lit(0)))
    totals = totals.select(F.col(k).alias("k"), F.col("slice").alias("s"), "n")
    got = begun.join(totals, begun[k].eqNullSafe(totals["k"]) & begun["slice"].eqNullSafe(totals["s"]))
    return got.select(*[F.col(n).alias(c) for n, c in zip(names, events.columns)], (F.col("n") + F.col("nth")).alias("session"))
