"""Joins whose strategy depends on sizes and skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner", max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcasts right if the optimiser's estimate of its size is within max_bytes, else leaves the strategy to the engine."""
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= max_bytes else right, on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int) -> DataFrame:
    """Inner join with each key of left dealt over `salts` parts; right is repeated as often. For keys hot beyond what
    the engine's own skew split handles, such as under an aggregate that needs the key's partitioning."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(spread, [*on, "_salt"]).drop("_salt")


def salted_aggregate(df: DataFrame, keys: list[str], salts: int, partial: dict, final: dict) -> DataFrame:
    """Two-step aggregate for functions without map-side partials: partial by key and salt, then final by key."""
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    first = dealt.groupBy(*keys, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return first.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])
