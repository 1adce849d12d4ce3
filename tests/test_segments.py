"""The connector: round trips, pruning by pushed filters, and jobs that fail half way."""

import pytest
from pyspark.sql import functions as F

from heronq.sources.segments import FORMAT, SegmentReader, SegmentSource, manifest

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def path(spark, tmp_path):
    spark.dataSource.register(SegmentSource)
    return f"file://{tmp_path}/t"


def write(df, path, mode="append"):
    df.write.format(FORMAT).option("path", path).option("key", "k").mode(mode).save()


def numbers(spark, n):
    return spark.range(n).repartitionByRange(4, "id").select(F.when(F.col("id") % 7 != 6, F.col("id")).alias("k"), F.concat(F.lit("é"), "id").alias("s"), F.array("id").alias("a"))


def test_append_and_overwrite(spark, path):
    df = numbers(spark, 40)
    read = lambda: sorted(map(str, spark.read.format(FORMAT).option("path", path).load().collect()))
    write(df, path)
    want = sorted(map(str, df.collect()))
    assert read() == want
    write(df, path)
    assert read() == sorted(want * 2)
    write(df.where("k < 3"), path, "overwrite")
    assert len(read()) == 3
    write(df.limit(0), path, "overwrite")
    assert read() == []


def test_filters_prune_segments(spark, path):
    write(numbers(spark, 400), path)
    assert len(manifest(path)["segments"]) == 4
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        table = spark.read.format(FORMAT).option("path", path).option("pushdown", "true").load()
        for text, most in [("k = 5", 1), ("k > 350", 1), ("k >= 390 and k < 395", 1), ("k in (1, 399)", 4), ("k <= 150", 2), ("k < 0", 0)]:
            df = table.where(text)
            assert df.rdd.getNumPartitions() <= max(1, most), text
            assert sorted(r.k for r in df.collect()) == sorted(r.k for r in numbers(spark, 400).where(text).collect())
        assert table.where("k is null").count() == 57
    finally:
        spark.conf.set(PUSHDOWN, before)


def test_failed_job_leaves_nothing(spark, path):
    write(numbers(spark, 10), path)
    bad = numbers(spark, 400).where(F.when(F.col("k") == 399, F.raise_error(F.lit("stop")).cast("boolean")).otherwise(True))
    with pytest.raises(Exception, match="stop"):
        write(bad, path)
    assert spark.read.format(FORMAT).option("path", path).load().count() == 10


def test_no_table(path):
    assert manifest(path) is None and SegmentReader(path).partitions() == []
