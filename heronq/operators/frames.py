"""Grouped and windowed forms used by several queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, ties: bool = True) -> DataFrame:
    """The first k rows of each group, with rows tied at the end if ties; adds rk. The engine cuts groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rk", (F.rank() if ties else F.row_number()).over(w)).where(F.col("rk") <= k)


def percentile_rounded(column: str, share: float, places: int = 6) -> Column:
    return F.round(F.percentile(column, share), places)
