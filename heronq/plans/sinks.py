"""Sources and sinks: tables written in a format and read back, with the answer the original table gives."""

from pyspark.sql import functions as F

from heronq.plans.catalog import query
from heronq.sources import formats
from heronq.sources.scratch import scratch
from heronq.sources.segments import FORMAT, SegmentSource

ORDERS = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus"


def orders_again(t, kind, **kw):
    path = scratch(t.spark) + f"/{kind}"
    formats.write(t.orders, kind, path, **kw)
    got = formats.read(t.spark, kind, path, t.orders.schema)
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last"))


@query(ORDERS)
def source_parquet(t):
    return orders_again(t, "parquet")


@query(ORDERS)
def source_partitioned(t):
    return orders_again(t, "parquet", partition_by=("o_orderstatus",))


@query(ORDERS)
def source_csv(t):
    return orders_again(t, "csv")


@query(ORDERS)
def source_json(t):
    return orders_again(t, "json")


@query(ORDERS)
def source_orc(t):
    return orders_again(t, "orc")


@query(ORDERS)
def source_xml(t):
    return orders_again(t, "xml")


@query("SELECT r_name AS value FROM region")
def source_text(t):
    path = scratch(t.spark) + "/text"
    t.region.select(F.col("r_name").alias("value")).write.text(path)
    return t.spark.read.text(path)


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def bucketed_tables(t):
    """Both sides bucketed alike: the join reads them without a shuffle."""
    import uuid

    a, b = (f"heronq_{x}_{uuid.uuid4().hex[:8]}" for x in ("orders", "customer"))
    where = scratch(t.spark)
    t.orders.select("o_custkey").write.bucketBy(8, "o_custkey").sortBy("o_custkey").option("path", f"{where}/a").saveAsTable(a)
    t.customer.select("c_custkey", "c_mktsegment").write.bucketBy(8, "c_custkey").sortBy("c_custkey").option("path", f"{where}/b").saveAsTable(b)
    joined = t.spark.table(a).hint("merge").join(t.spark.table(b), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query(ORDERS)
def custom_source(t):
    """Written by a connector of one's own that commits, in segments of order keys, and read back by it."""
    t.spark.dataSource.register(SegmentSource)
    path = scratch(t.spark) + "/segments"
    t.orders.repartitionByRange(8, "o_orderkey").write.format(FORMAT).option("path", path).option("key", "o_orderkey").mode("append").save()
    got = t.spark.read.format(FORMAT).option("path", path).load()
    return got.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderdate").alias("last"))
