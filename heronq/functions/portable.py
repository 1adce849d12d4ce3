"""Functions with one meaning here, whatever the engine's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_divide(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a, b)


def iso_weekday(c: Column | str) -> Column:
    """1 for Monday to 7 for Sunday."""
    return (F.weekday(c) + 1).cast("bigint")


def whole_days(a: Column | str, b: Column | str) -> Column:
    """Midnights from b to a."""
    return F.datediff(a, b).cast("bigint")


def time_bucket(seconds: int, c: Column | str) -> Column:
    """The start of the bucket of fixed length since 1970 that holds a time."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.unix_seconds(c.cast("timestamp"))
    return F.timestamp_seconds(at - F.pmod(at, F.lit(seconds)))
