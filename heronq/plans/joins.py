"""Join queries."""

from pyspark.sql import functions as F

from heronq.operators.joining import join_small, salted_aggregate, salted_join
from heronq.operators.timeline import asof_join, range_join
from heronq.plans.catalog import query


def net():
    """What a line item earns."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY n_name""")
def supplier_volume(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    places = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = t.orders.where((F.col("o_orderdate") >= day("1996-01-01")) & (F.col("o_orderdate") < day("1998-01-01"))).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    suppliers = join_small(t.supplier, places, F.col("s_nationkey") == F.col("n_nationkey"))
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(F.round(F.sum(net()), 2).alias("revenue"))


@query("""
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(t):
    day = F.lit("1998-03-15").cast("timestamp_ntz")
    o = t.orders.where(F.col("o_orderdate") < day).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"))
    rows = t.lineitem.where(F.col("l_shipdate") > day).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(net()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey - 5")
def full_join(t):
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey") - 5, "full").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_name LIKE 'A%'")
def right_join(t):
    return t.nation.join(t.region, (F.col("n_regionkey") == F.col("r_regionkey")) & F.col("n_name").like("A%"), "right").select("r_name", "n_name")


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
def cross_join(t):
    return t.region.select(F.col("r_name").alias("a")).crossJoin(t.region.select(F.col("r_name").alias("b")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def not_in(t):
    return t.sql("SELECT p_partkey FROM {part} WHERE p_partkey NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)", "part", "lineitem")


@query("SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_hints(t):
    merged = t.lineitem.join(t.part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))
    hashed = t.lineitem.join(t.part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"))
    return merged.intersect(hashed)


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def theta_join(t):
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS low, s_acctbal + 2 AS high FROM supplier) s ON p_retailprice >= low AND p_retailprice < high")
def range_join_by_buckets(t):
    spans = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 2).alias("high"))
    return range_join(t.part, spans, "p_retailprice", "low", "high", 4.0).select("p_partkey", "s_suppkey")


@query("""
SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_same_table(t):
    views = t.events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return asof_join(t.events.where("event_type = 'purchase'"), views, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


@query("""
SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, user_id AS k, ts FROM events) e
ASOF LEFT JOIN (SELECT o_custkey AS k, max(o_orderkey) AS o_orderkey, o_orderdate + INTERVAL 9000 DAY - INTERVAL 300 DAY AS ts FROM orders GROUP BY o_custkey, o_orderdate) o ON e.k = o.k AND e.ts >= o.ts""")
def asof_two_tables(t):
    orders = t.orders.groupBy(F.col("o_custkey").alias("k"), F.expr("o_orderdate + INTERVAL 9000 DAY - INTERVAL 300 DAY").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return asof_join(t.events.select("event_id", F.col("user_id").alias("k"), "ts"), orders, ["k"], "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("SELECT c_custkey, x.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) x")
def lateral_join(t):
    """ORDER BY with LIMIT in a correlated subquery becomes a window without an order over sorted rows, which a shuffle mixes: the rank is explicit."""
    ranked = "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS n FROM {orders}"
    return t.sql(f"SELECT c_custkey, x.o_orderkey FROM {{customer}}, LATERAL (SELECT o_orderkey FROM ({ranked}) WHERE o_custkey = c_custkey AND n <= 2) x", "customer", "orders")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem l WHERE l_quantity > (SELECT 1.9 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
def correlated_scalar(t):
    return t.sql("SELECT l_orderkey, l_partkey, l_quantity FROM {lineitem} l WHERE l_quantity > (SELECT 1.9D * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)", "lineitem")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
def uncorrelated_scalar(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.9D * avg(o_totalprice) FROM {orders})", "orders")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def salted(t):
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = salted_join(t.orders.select("o_custkey", "o_totalprice"), c, ["o_custkey"], 4)
    return salted_aggregate(rows, ["c_mktsegment"], 8, {"n": F.count("*"), "total": F.sum("o_totalprice")}, {"n": F.sum("n"), "total": F.round(F.sum("total"), 1)})
