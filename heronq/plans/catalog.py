"""The registered queries, each with the SQL that DuckDB must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Tables under its name as a query of (spark, sf_dir)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a folder by attribute: t.orders. t.spark and t.dir are the session and the folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """Runs SQL over the tables named."""
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})


from heronq.plans import corpus, joins, relational, scalars, sinks, streams, user_code  # noqa: E402,F401
