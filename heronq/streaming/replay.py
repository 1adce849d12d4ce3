"""Tables replayed as streams, and streams run to their end."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronq.sources.scratch import scratch

#: Rows of a slice's file on average, at most.
FILE_ROWS = 250_000


def replay(spark: SparkSession, events: DataFrame, time: str = "ts", files: int = 6, order: tuple[int, ...] | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A stream of the rows in slices of equal time, one slice in each micro-batch; time becomes a zoned timestamp.

    order: the order in which slices come, by default that of time. bounds: the first and last second sliced, by default those of the rows.
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    lo, hi, n = rows.agg(F.min(time).cast("long"), F.max(time).cast("long"), F.count(time)).first()
    lo, hi = bounds or (lo, hi)
    path = scratch(spark)
    # as many files in each slice, and later times for those of later slices: a batch takes the files of one slice
    pieces = max(1, -(-n // (files * FILE_ROWS)))
    for turn, k in enumerate(order or range(files) if lo is not None else ()):
        a, b = lo + (hi + 1 - lo) * k // files, lo + (hi + 1 - lo) * (k + 1) // files
        mine = rows.where((F.col(time).cast("long") >= a) & (F.col(time).cast("long") < b))
        (mine.repartition(pieces) if pieces > 1 else mine.coalesce(1)).write.mode("append").parquet(path)
        if pieces > 1:  # parts without rows write no files
            for _ in range((turn + 1) * pieces - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
                spark.createDataFrame([], rows.schema).write.mode("append").parquet(path)
    if lo is None:
        rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", pieces).parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs all there is through a sink that keeps, for each batch, what the mode emits; in complete mode the last batch counts."""
    spark = stream.sparkSession
    where = scratch(spark)

    def keep(df, batch):
        df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{where}/out/b{batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{where}/out") if q.recentProgress else spark.createDataFrame([], schema)
    if mode == "complete":
        last = got.agg(F.max("_batch")).first()[0]
        got = got.where(F.col("_batch") == F.lit(last))
    return got.drop("_batch") if mode != "update" else got


class JsonLines:
    """For foreach: the rows of a partition and batch as lines of a file in a shared folder, moved into place once whole."""

    def __init__(self, folder: str):
        self.folder = folder

    def open(self, partition: int, batch: int) -> bool:
        self.name, self.lines = f"b{batch}-p{partition}.json", []
        return True

    def process(self, row: Row) -> None:
        self.lines.append(json.dumps(row.asDict(), default=str))

    def close(self, error: Exception | None) -> None:
        if error is not None or not self.lines:
            return
        files, path = fs.FileSystem.from_uri(self.folder)
        files.create_dir(path)
        hidden = posixpath.join(path, f"_{uuid.uuid4().hex}")  # readers pass over names with an underscore
        with files.open_output_stream(hidden) as f:
            f.write("".join(line + "\n" for line in self.lines).encode())
        files.move(hidden, posixpath.join(path, self.name))
