"""Projection, filter, reshape, aggregation, window, sort and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronq.operators.frames import percentile_rounded, top_per_group
from heronq.operators.graph import reachable
from heronq.plans.catalog import query

LONG, DOUBLE = "bigint", "double"


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
            F.round(F.sum(net), 2).alias("sum_disc"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
    )


@query("""
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(t):
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = t.lineitem.where((F.col("l_shipdate") >= day("1997-01-01")) & (F.col("l_shipdate") < day("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'A'")
def scan_filter_project(t):
    return t.lineitem.where("l_quantity < 3 AND l_returnflag = 'A'").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_totalprice * 1.1 AS gross, upper(o_orderstatus) AS status, o_custkey + 1 AS next_cust FROM orders")
def derived_columns(t):
    return t.orders.withColumns({"gross": F.col("o_totalprice") * 1.1, "status": F.upper("o_orderstatus"), "next_cust": F.col("o_custkey") + 1}).select("o_orderkey", "gross", "status", "next_cust")


@query("""
SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 0 AND 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
  AND nullif(c_nationkey, 5) IS NOT DISTINCT FROM nullif(c_nationkey, 7) AND c_name LIKE '%1%' AND regexp_matches(c_name, '[0-9]+5$')""")
def predicates(t):
    c = t.customer
    return c.where(c.c_acctbal.between(0, 5000) & c.c_mktsegment.isin("BUILDING", "MACHINERY") & F.nullif(c.c_nationkey, F.lit(5)).eqNullSafe(F.nullif(c.c_nationkey, F.lit(7))) & c.c_name.like("%1%") & c.c_name.rlike("[0-9]+5$")).select("c_custkey")


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band,
  coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, greatest(p_size, 20) AS hi, least(p_size, 20) AS lo FROM part""")
def conditionals(t):
    band = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return t.part.select("p_partkey", band.alias("band"), F.nvl(F.nullif("p_brand", F.lit("Brand#11")), F.lit("none")).alias("brand"), F.greatest("p_size", F.lit(20)).alias("hi"), F.least("p_size", F.lit(20)).alias("lo"))


@query("""
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P"
FROM orders GROUP BY o_orderpriority""")
def pivot(t):
    return t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""
SELECT s_suppkey, 'key' AS what, s_nationkey::DOUBLE AS val FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier""")
def unpivot(t):
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").cast(DOUBLE).alias("key"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["key", "balance"], "what", "val")


@query("SELECT c_custkey, unnest(string_split(c_name, '#')) AS part FROM customer")
def explode(t):
    return t.customer.select("c_custkey", F.explode(F.split("c_name", "#")).alias("part"))


@query("""
SELECT c_custkey, (i - 1)::BIGINT AS at, string_split(c_name, '#')[i] AS part FROM customer, range(1, 3) r(i) WHERE i <= len(string_split(c_name, '#'))""")
def posexplode(t):
    return t.customer.select("c_custkey", F.posexplode(F.split("c_name", "#")).alias("at", "part")).withColumn("at", F.col("at").cast(LONG))


@query("SELECT n_nationkey, unnest([n_name, n_regionkey::VARCHAR]) AS val FROM nation")
def inline(t):
    return t.nation.select("n_nationkey", F.inline(F.array(F.struct(F.col("n_name").alias("val")), F.struct(F.col("n_regionkey").cast("string").alias("val")))))


@query()
def sampling(t):
    return t.orders.sample(False, 0.1, 7).select("o_orderkey").unionByName(t.orders.sampleBy("o_orderstatus", {"F": 0.05, "P": 0.5}, seed=7).select("o_orderkey"))


@query()
def random_split(t):
    a, b = t.customer.randomSplit([0.8, 0.2], seed=3)
    return a.select(F.lit("train").alias("part"), "c_custkey").unionByName(b.select(F.lit("test").alias("part"), "c_custkey"))


# aggregation


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_suppkey")
def count_distinct(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_returnflag").alias("flags"))


@query("""
SELECT event_type, round(stddev(value), 6) AS sd, round(median(value), 6) AS med, round(var_pop(value), 5) AS vp, round(skewness(value), 4) AS skew_raw
FROM events GROUP BY event_type""")
def deviation_and_median(t):
    n = F.count("value").cast(DOUBLE)
    # DuckDB's skewness is the sample one
    skew = F.skewness("value") * F.sqrt(n * (n - 1)) / (n - 2)
    return t.events.groupBy("event_type").agg(F.round(F.stddev("value"), 6).alias("sd"), F.round(F.median("value"), 6).alias("med"), F.round(F.var_pop("value"), 5).alias("vp"), F.round(skew, 4).alias("skew_raw"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.25), 6) AS p25 FROM events GROUP BY event_type")
def exact_percentiles(t):
    return t.events.groupBy("event_type").agg(percentile_rounded("value", 0.9).alias("p90"), percentile_rounded("value", 0.25).alias("p25"))


@query("""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 3) AS cs,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag""")
def correlation_and_regression(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(F.covar_samp("l_quantity", "l_extendedprice"), 3).alias("cs"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("icpt"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"),
    )


@query()
def approximate_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query()
def sketches(t):
    e = t.events
    by_type = e.groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("users"), F.approx_percentile("value", [0.5, 0.99], 1000).alias("q"))
    return by_type.select("event_type", F.hll_sketch_estimate("users").alias("users"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p99"))


@query()
def sketch_union(t):
    e = t.events.groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("s"), F.theta_sketch_agg("user_id").alias("th"))
    return e.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"), F.theta_sketch_estimate(F.theta_union_agg("th")).alias("theta_users"))


@query()
def count_min(t):
    """A count-min sketch of the users of each kind of event; CountMinSketch of the engine's Java library reads it."""
    return t.events.groupBy("event_type").agg(F.count_min_sketch(F.col("user_id"), F.lit(0.001), F.lit(0.99), F.lit(7)).alias("sketch"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority)::BIGINT AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    li = t.lineitem
    return li.groupingSets([[li.l_returnflag], [li.l_linestatus], []], li.l_returnflag, li.l_linestatus).agg(F.sum("l_quantity").alias("q"))


@query("""
SELECT n_regionkey, list(n_name ORDER BY n_name) AS names, string_agg(n_name, ',' ORDER BY n_name DESC) AS joined, string_agg(DISTINCT n_name[1:1], '') AS letters, list(n_nationkey ORDER BY n_nationkey) AS keys
FROM nation GROUP BY n_regionkey""")
def collected(t):
    return t.sql("""
        SELECT n_regionkey, sort_array(collect_list(n_name)) AS names, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS joined, array_join(collect_set(left(n_name, 1)), '') AS letters,
          sort_array(array_agg(n_nationkey)) AS keys FROM {nation} GROUP BY n_regionkey""", "nation")


@query("""
WITH segments AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL),
modes AS (SELECT c_nationkey, c_mktsegment AS usual FROM segments QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1)
SELECT c_nationkey, arg_max(c_custkey, c_custkey) AS last_key, arg_min(c_name, c_custkey) AS first_name, any_value(usual) AS usual, any_value(c_nationkey * 2) AS twice FROM customer JOIN modes USING (c_nationkey) GROUP BY c_nationkey""")
def extremes_by(t):
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", "c_custkey").alias("last_key"), F.min_by("c_name", "c_custkey").alias("first_name"), F.mode("c_mktsegment", True).alias("usual"), F.any_value(F.col("c_nationkey") * 2).alias("twice"))


@query("""
SELECT l_linestatus, bool_and(l_quantity > 0) AS every_pos, bool_or(l_quantity > 49) AS any_big, count_if(l_discount = 0)::BIGINT AS free,
  bit_and(l_linenumber)::BIGINT AS ba, bit_or(l_linenumber)::BIGINT AS bo, bit_xor(l_linenumber)::BIGINT AS bx FROM lineitem GROUP BY l_linestatus""")
def boolean_and_bit_aggregates(t):
    n = F.col("l_linenumber").cast(LONG)
    return t.lineitem.groupBy("l_linestatus").agg(F.bool_and(F.col("l_quantity") > 0).alias("every_pos"), F.bool_or(F.col("l_quantity") > 49).alias("any_big"), F.count_if(F.col("l_discount") == 0).alias("free"), F.bit_and(n).alias("ba"), F.bit_or(n).alias("bo"), F.bit_xor(n).alias("bx"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("spent")).where("n > 12")


# windows


@query("SELECT c_nationkey, c_custkey, rk FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer) WHERE rk <= 3")
def top_per_nation(t):
    return top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal")], 3).select("c_nationkey", "c_custkey", F.col("rk").cast(LONG))


@query("SELECT event_id, row_number() OVER w AS rn, ntile(4) OVER w AS q, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS dr FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def numbering(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", F.row_number().over(w).cast(LONG).alias("rn"), F.ntile(4).over(w).cast(LONG).alias("q"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast(LONG).alias("dr"))


@query("SELECT s_suppkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)")
def relative_ranks(t):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return t.supplier.select("s_suppkey", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("""
SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after2, first_value(event_type) OVER w AS first_type, nth_value(event_id, 2) OVER w AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def offsets_in_windows(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    return t.events.select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id", 2).over(w).alias("after2"), F.first_value("event_type").over(w).alias("first_type"), F.nth_value("event_id", 2).over(w).alias("second"))


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
  round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS sliding,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def frames(t):
    w = Window.partitionBy("user_id").orderBy("ts")
    by_second = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-86400, 0)
    return t.events.select(
        "event_id",
        F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"),
        F.round(F.avg("value").over(w.rowsBetween(-2, 1)), 4).alias("sliding"),
        F.count("*").over(by_second).alias("last_day"),
    )


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def qualify(t):
    return top_per_group(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], 1, ties=False).select("o_orderkey", "o_custkey")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g)
SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(t):
    from heronq.operators.timeline import sessionize

    return sessionize(t.events, "user_id", "ts", 30 * 60).groupBy("user_id", "session").agg(F.count("*").alias("n"))


# sort, limit, sets


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 15")
def offset(t):
    return t.customer.orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey").offset(15).limit(20).select("c_custkey")


@query()
def sorted_partitions(t):
    return t.orders.repartition(8, "o_custkey").sortWithinPartitions("o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
def union_all_by_name(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(t.supplier.select(F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def intersect(t):
    return t.lineitem.select(F.col("l_partkey").alias("k")).intersect(t.part.where("p_size > 25").select("p_partkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def except_distinct(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


#: From each region to its nations and the classes of their suppliers, by name.
_TREE = """WITH RECURSIVE edges AS (SELECT concat('r', n_regionkey) AS up, concat('n', n_nationkey) AS down, n_name AS name FROM {nation}
  UNION ALL SELECT DISTINCT concat('n', s_nationkey), concat('s', s_nationkey, '/', CAST(floor(s_acctbal / 1000) AS INTEGER)), concat('class ', CAST(floor(s_acctbal / 1000) AS INTEGER)) FROM {supplier}),
tree(node, path, depth) AS (SELECT concat('r', r_regionkey), CAST(r_name AS {text}), 0 FROM {region}
  UNION ALL SELECT e.down, concat(t.path, ' > ', e.name), t.depth + 1 FROM tree t JOIN edges e ON e.up = t.node)
SELECT path, depth FROM tree"""


@query(_TREE.format(text="VARCHAR", region="region", nation="nation", supplier="supplier"))
def recursive_cte(t):
    """Paths down a hierarchy: the recursive term joins what is read from the tables."""
    return t.sql(_TREE.replace("{text}", "STRING"), "region", "nation", "supplier")


@query("""
WITH RECURSIVE steps AS (SELECT event_id AS a, lead(event_id) OVER w AS b, ts, lead(ts) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT a, b FROM steps WHERE next - ts <= INTERVAL 2 HOUR),
reach(node, hops) AS (SELECT event_id, 0::BIGINT FROM events WHERE event_type = 'signup' UNION SELECT e.b, hops + 1 FROM reach JOIN e ON e.a = node)
SELECT node, min(hops) AS hops FROM reach GROUP BY node""")
def recursive_reach(t):
    """What follows a signup of the same user in steps of at most two hours, and in how few: recursion until nothing is new."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = t.events.select(F.col("event_id").alias("a"), F.lead("event_id").over(w).alias("b"), "ts", F.lead("ts").over(w).alias("next"))
    return reachable(steps.where("next - ts <= interval 2 hours").select("a", "b"), t.events.where("event_type = 'signup'").select(F.col("event_id").alias("node")))
