"""Reading and writing tables by format name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Options with which a table read back equals the one written.
OPTIONS = {"csv": {"header": "true", "nullValue": "\\N", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}, "json": {"ignoreNullFields": "false"}, "xml": {"rowTag": "row"}, "parquet": {}, "orc": {}}


def write(df: DataFrame, kind: str, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.format(kind).options(**OPTIONS.get(kind, {})).mode(mode).partitionBy(*partition_by).save(path)


def read(spark: SparkSession, kind: str, path: str, schema: T.StructType | str) -> DataFrame:
    """Always by a stated schema: no pass over the data to infer one."""
    return spark.read.format(kind).options(**OPTIONS.get(kind, {})).schema(schema).load(path)
