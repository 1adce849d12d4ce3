"""User-defined functions of each kind the engine takes."""

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from heronq.plans.catalog import query


@query("SELECT n_nationkey, reverse(n_name) AS back FROM nation")
def udf_scalar(t):
    back = F.udf(lambda s: None if s is None else s[::-1], "string")
    return t.nation.select("n_nationkey", back("n_name").alias("back"))


@query("SELECT p_partkey, p_retailprice * 1.5 AS price FROM part")
def udf_pandas(t):
    @F.pandas_udf("double")
    def dearer(s: pd.Series) -> pd.Series:
        return s * 1.5

    return t.part.select("p_partkey", dearer("p_retailprice").alias("price"))


@query("SELECT p_partkey, upper(p_name) AS name FROM part")
def udf_arrow(t):
    @F.arrow_udf("string")
    def upper(s: pa.Array) -> pa.Array:
        return pc.utf8_upper(s)

    return t.part.select("p_partkey", upper("p_name").alias("name"))


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 2) AS spread FROM customer GROUP BY c_nationkey")
def udaf_pandas(t):
    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    return t.customer.groupBy("c_nationkey").agg(F.round(spread("c_acctbal"), 2).alias("spread"))


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def udtf(t):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in (text or "").split(" "):
                yield (w,)

    t.spark.udtf.register("heronq_words", Words)
    return t.sql("SELECT n_nationkey, w.word FROM {nation}, LATERAL heronq_words(n_name) w", "nation")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_arrow(t):
    """A table function over whole Arrow batches of a table."""

    @F.arrow_udtf(returnType="p_partkey long, word string")
    class Words:
        def eval(self, batch: pa.RecordBatch):
            words = pc.split_pattern(batch.column("p_name"), " ")
            yield pa.table({"p_partkey": batch.column("p_partkey").take(pc.list_parent_indices(words)), "word": pc.list_flatten(words)})

    return Words(t.part.select("p_partkey", "p_name").asTable())


@query("SELECT o_orderkey, o_totalprice * 1.19 AS gross FROM orders")
def sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION heronq_gross(x DOUBLE, rate DOUBLE) RETURNS DOUBLE RETURN x * rate")
    return t.sql("SELECT o_orderkey, heronq_gross(o_totalprice, 1.19D) AS gross FROM {orders}", "orders")


@query("SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size > 40")
def map_in_pandas(t):
    def run(frames):
        for f in frames:
            f = f[f.p_size > 40]
            yield pd.DataFrame({"p_partkey": f.p_partkey, "twice": f.p_size * 2})

    return t.part.select("p_partkey", "p_size").mapInPandas(run, "p_partkey long, twice int")


@query("SELECT p_partkey FROM part WHERE p_size <= 5")
def map_in_arrow(t):
    def run(batches):
        for b in batches:
            yield b.filter(pc.less_equal(b.column(1), 5)).select(["p_partkey"])

    return t.part.select("p_partkey", "p_size").mapInArrow(run, "p_partkey long")


@query("SELECT c_nationkey, c_custkey FROM customer QUALIFY c_acctbal = max(c_acctbal) OVER (PARTITION BY c_nationkey)")
def apply_in_pandas(t):
    def best(f):
        return f[f.c_acctbal == f.c_acctbal.max()][["c_nationkey", "c_custkey"]]

    return t.customer.select("c_nationkey", "c_custkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(best, "c_nationkey int, c_custkey long")


@query("SELECT n_nationkey, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey HAVING count(DISTINCT c_custkey) + count(DISTINCT s_suppkey) > 0")
def cogroup(t):
    def both(key, a, b):
        return pd.DataFrame({"n_nationkey": [key[0]], "customers": [len(a)], "suppliers": [len(b)]})

    a, b = t.customer.select("c_nationkey", "c_custkey"), t.supplier.select("s_nationkey", "s_suppkey")
    return a.groupBy("c_nationkey").cogroup(b.groupBy("s_nationkey")).applyInPandas(both, "n_nationkey int, customers long, suppliers long")
