"""Scalar function families, over columns of the tables."""

from pyspark.sql import functions as F

from heronq.functions.portable import iso_weekday, safe_divide, time_bucket, whole_days
from heronq.plans.catalog import query

L = "bigint"


@query("""
SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, substring(c_name, 1, 4) AS c, lower(c_mktsegment) AS d,
  trim('  ' || c_name || ' ') AS e, lpad(c_custkey::VARCHAR, 8, '0') AS f, rpad(c_mktsegment, 12, '*') AS g, repeat(c_mktsegment, 2) AS h, reverse(c_name) AS i,
  translate(c_name, 'Cu', 'Ku') AS j, instr(c_name, '#') AS k, length(c_name) AS l, left(c_name, 3) AS m, right(c_name, 3) AS n, split_part(c_name, '#', 2) AS o, levenshtein(c_mktsegment, 'BUILDING') AS p,
  starts_with(c_mktsegment, 'B') AS q, contains(c_mktsegment, 'IN') AS r, ascii(c_mktsegment)::BIGINT AS s, replace(c_name, '#', '_') AS t FROM customer""")
def string_functions(t):
    n, m = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.concat(n, F.lit("/"), m).alias("a"),
        F.concat_ws("-", n, F.lit(None).cast("string"), m).alias("b"),
        F.substring(n, 1, 4).alias("c"),
        F.lower(m).alias("d"),
        F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("e"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("f"),
        F.rpad(m, 12, "*").alias("g"),
        F.repeat(m, 2).alias("h"),
        F.reverse(n).alias("i"),
        F.translate(n, "Cu", "Ku").alias("j"),
        F.instr(n, "#").cast(L).alias("k"),
        F.length(n).cast(L).alias("l"),
        F.left(n, F.lit(3)).alias("m"),
        F.right(n, F.lit(3)).alias("n"),
        F.split_part(n, F.lit("#"), F.lit(2)).alias("o"),
        F.levenshtein(m, F.lit("BUILDING")).cast(L).alias("p"),
        F.startswith(m, F.lit("B")).alias("q"),
        F.contains(m, F.lit("IN")).alias("r"),
        F.ascii(m).cast(L).alias("s"),
        F.replace(n, F.lit("#"), F.lit("_")).alias("t"),
    )


@query("""
SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS a, regexp_replace(p_type, '[AEIOU]', '.', 'g') AS b, regexp_matches(p_type, '^S.*') AS c, regexp_extract_all(p_brand, '[0-9]') AS d,
  len(string_split(p_name, ' '))::BIGINT AS e FROM part""")
def regex_functions(t):
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("a"), F.regexp_replace("p_type", "[AEIOU]", ".").alias("b"), F.regexp_like("p_type", F.lit("^S.*")).alias("c"), F.regexp_extract_all("p_brand", F.lit("[0-9]"), F.lit(0)).alias("d"), F.size(F.split("p_name", " ")).cast(L).alias("e"))


@query("""
SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, n_name[1:1] || '__' || n_name[4:] AS over,
  printf('%s-%03d', n_name, n_nationkey) AS formatted FROM nation""")
def string_shapes(t):
    return t.nation.select("n_nationkey", F.initcap(F.lower("n_name")).alias("title"), F.overlay("n_name", F.lit("__"), 2).alias("over"), F.format_string("%s-%03d", "n_name", "n_nationkey").alias("formatted"))


@query()
def soundex(t):
    return t.region.select("r_name", F.soundex("r_name").alias("sound"))


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS a, (o_orderdate::DATE + 10) AS b, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS c, (o_orderdate + INTERVAL 2 MONTH)::DATE AS d,
  last_day(o_orderdate) AS e, year(o_orderdate) AS f, quarter(o_orderdate) AS g, month(o_orderdate) AS h, day(o_orderdate) AS i, isodow(o_orderdate) AS j, week(o_orderdate) AS k, dayofyear(o_orderdate) AS l,
  make_date(year(o_orderdate), 1, 1) AS m, strftime(o_orderdate, '%Y/%m/%d') AS n, epoch(o_orderdate)::BIGINT AS o FROM orders""")
def date_functions(t):
    d = F.col("o_orderdate")
    day = d.cast("date")
    return t.orders.select(
        "o_orderkey",
        F.date_trunc("month", d).cast("timestamp_ntz").alias("a"),
        F.date_add(day, 10).alias("b"),
        whole_days(day, F.lit("1995-01-01").cast("date")).alias("c"),
        F.add_months(day, 2).alias("d"),
        F.last_day(day).alias("e"),
        F.year(d).cast(L).alias("f"),
        F.quarter(d).cast(L).alias("g"),
        F.month(d).cast(L).alias("h"),
        F.dayofmonth(d).cast(L).alias("i"),
        iso_weekday(day).alias("j"),
        F.weekofyear(d).cast(L).alias("k"),
        F.dayofyear(d).cast(L).alias("l"),
        F.make_date(F.year(d), F.lit(1), F.lit(1)).alias("m"),
        F.date_format(d, "yyyy/MM/dd").alias("n"),
        F.unix_seconds(d.cast("timestamp")).alias("o"),
    )


@query("""
SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS a, hour(ts) AS b, minute(ts) AS c, (ts + INTERVAL 90 MINUTE)::TIMESTAMP AS d, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS e FROM events""")
def time_functions(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        time_bucket(6 * 3600, ts).cast("timestamp_ntz").alias("a"),
        F.hour(ts).cast(L).alias("b"),
        F.minute(ts).cast(L).alias("c"),
        (ts + F.expr("INTERVAL 90 MINUTE")).alias("d"),
        F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp"), F.date_trunc("hour", ts)).cast(L).alias("e"),
    )


@query("""
SELECT o_orderkey, o_orderdate::DATE + (8 - isodow(o_orderdate))::INTEGER AS monday,
  round((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 + (day(o_orderdate) - 1) / 31.0::DOUBLE, 6) AS months, (dayofweek(o_orderdate) + 1)::BIGINT AS weekday,
  extract(year FROM o_orderdate)::BIGINT AS y, extract(doy FROM o_orderdate)::BIGINT AS doy, (o_orderdate + INTERVAL 5 HOUR)::TIMESTAMP AS later, TIMESTAMP '2024-01-02 03:04:05' AS at FROM orders""")
def calendar_functions(t):
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        "o_orderkey",
        F.next_day(d, "Mon").alias("monday"),
        F.round(F.months_between(d, F.lit("1995-01-01").cast("date")), 6).alias("months"),
        F.dayofweek(d).cast(L).alias("weekday"),
        F.extract(F.lit("YEAR"), d).cast(L).alias("y"),
        F.extract(F.lit("DOY"), d).cast(L).alias("doy"),
        F.timestamp_add("HOUR", F.lit(5), "o_orderdate").alias("later"),
        F.to_timestamp(F.lit("2024-01-02 03:04:05")).cast("timestamp_ntz").alias("at"),
    )


@query("SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN '0 seconds' ELSE r_regionkey || ' years' END AS span FROM region")
def intervals(t):
    return t.region.select("r_regionkey", F.make_interval(F.col("r_regionkey")).cast("string").alias("span"))


@query("""
SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal / 3, 3) AS b, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS d, (s_suppkey % 7)::BIGINT AS e, power(s_suppkey, 2)::DOUBLE AS f,
  round(sqrt(s_suppkey), 9) AS g, round(cbrt(s_suppkey), 9) AS h, round(ln(nullif(s_suppkey, 0)), 9) AS i, round(log10(nullif(s_suppkey, 0)), 9) AS j, round(exp(s_suppkey / 1000.0::DOUBLE), 9) AS k, sign(s_acctbal)::DOUBLE AS l,
  greatest(s_acctbal, 0::DOUBLE) AS m, round(sin(s_suppkey), 9) AS n, round(atan2(s_suppkey, 2), 9) AS o, bit_count(s_suppkey)::BIGINT AS p, bin(s_suppkey) AS q, round(degrees(s_suppkey), 6) AS r,
  CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal / (s_suppkey % 2) END AS s, round(log2(nullif(s_suppkey, 0)), 9) AS t, factorial((s_suppkey % 10)::INTEGER)::BIGINT AS u FROM supplier""")
def math_functions(t):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    nine = lambda c: F.round(c, 9)
    return t.supplier.select(
        "s_suppkey",
        F.abs(b).alias("a"),
        F.round(b / 3, 3).alias("b"),
        F.ceil(b).alias("c"),
        F.floor(b).alias("d"),
        F.pmod(k, F.lit(7)).cast(L).alias("e"),
        F.power(k, F.lit(2)).alias("f"),
        nine(F.sqrt(k)).alias("g"),
        nine(F.cbrt(k)).alias("h"),
        nine(F.ln(k)).alias("i"),
        nine(F.log10(k)).alias("j"),
        nine(F.exp(k / F.lit(1000.0))).alias("k"),
        F.sign(b).alias("l"),
        F.greatest(b, F.lit(0.0)).alias("m"),
        nine(F.sin(k)).alias("n"),
        nine(F.atan2(k.cast("double"), F.lit(2.0))).alias("o"),
        F.bit_count(k).cast(L).alias("p"),
        F.bin(k).alias("q"),
        F.round(F.degrees(k.cast("double")), 6).alias("r"),
        safe_divide(b, (k % 2).cast("double")).alias("s"),
        nine(F.log2(k)).alias("t"),
        F.factorial((k % 10).cast("int")).alias("u"),
    )


@query("""
WITH p AS (SELECT *, round(p_retailprice * 100)::BIGINT AS cents FROM part)
SELECT p_partkey, CASE WHEN p_retailprice >= 2000 THEN 11 ELSE floor(p_retailprice / 200) + 1 END::BIGINT AS bucket, to_base(p_size, 36) AS base36, round(log(3, p_size), 9) AS log3,
  (cents // 10 + CASE WHEN cents % 10 > 5 OR cents % 10 = 5 AND cents // 10 % 2 = 1 THEN 1 ELSE 0 END) / 10 AS even FROM p""")
def numeric_shapes(t):
    p = F.col("p_retailprice")
    return t.part.select("p_partkey", F.width_bucket(p, F.lit(0.0), F.lit(2000.0), F.lit(10)).cast(L).alias("bucket"), F.conv(F.col("p_size").cast("string"), 10, 36).alias("base36"), F.round(F.log(3.0, "p_size"), 9).alias("log3"), F.bround(p, 1).alias("even"))


@query("""
WITH a AS (SELECT n_nationkey, [n_nationkey, n_regionkey, 3, 3] AS x, [1, 2, 3] AS y FROM nation)
SELECT n_nationkey, list_contains(x, 3) AS a, list_sort(list_distinct(x)) AS b, list_sort(list_intersect(x, y)) AS c, list_sort(x) AS d, flatten([x, y]) AS e, x[2:3] AS f, x[1] AS g,
  list_transform(x, lambda v: v * 2) AS h, list_filter(x, lambda v: v > 2) AS i, list_reduce(x, lambda p, q: p + q) AS j, len(x) AS k, list_max(x) AS l, array_to_string(list_transform(x, lambda v: v::VARCHAR), '|') AS m FROM a""")
def array_functions(t):
    k = lambda c: F.col(c)
    x, y = F.array(k("n_nationkey"), k("n_regionkey"), F.lit(3), F.lit(3)), F.array(F.lit(1), F.lit(2), F.lit(3))
    return t.nation.select(
        "n_nationkey",
        F.array_contains(x, 3).alias("a"),
        F.sort_array(F.array_distinct(x)).alias("b"),
        F.sort_array(F.array_intersect(x, y)).alias("c"),
        F.array_sort(x).alias("d"),
        F.flatten(F.array(x, y)).alias("e"),
        F.slice(x, 2, 2).alias("f"),
        F.element_at(x, 1).alias("g"),
        F.transform(x, lambda v: v * 2).alias("h"),
        F.filter(x, lambda v: v > 2).alias("i"),
        F.aggregate(x, F.lit(0), lambda p, v: p + v).alias("j"),
        F.size(x).cast(L).alias("k"),
        F.array_max(x).alias("l"),
        F.array_join(F.transform(x, lambda v: v.cast("string")), "|").alias("m"),
    )


@query("""
WITH a AS (SELECT r_regionkey, range(1, r_regionkey + 3)::INTEGER[] AS x, [2, 9] AS y FROM region)
SELECT r_regionkey, list_sort(list_distinct(x || y)) AS u, list_filter(x, lambda v: v <> 2 AND v <> 9) AS e, len(x)::BIGINT AS z, len(list_filter(x, lambda v: v > 3)) > 0 AS any, len(list_filter(x, lambda v: v <= 0)) = 0 AS every,
  list_transform(x, lambda v: v * v) AS zw FROM a""")
def array_set_functions(t):
    x, y = F.sequence(F.lit(1), F.col("r_regionkey") + 2), F.array(F.lit(2), F.lit(9))
    return t.region.select("r_regionkey", F.array_sort(F.array_union(x, y)).alias("u"), F.array_except(x, y).alias("e"), F.size(F.arrays_zip(x, x)).cast(L).alias("z"), F.exists(x, lambda v: v > 3).alias("any"), F.forall(x, lambda v: v > 0).alias("every"), F.zip_with(x, x, lambda a, b: a * b).alias("zw"))


@query("SELECT n_nationkey, len(map_keys(m)) AS a, m['r']::INTEGER AS b, s.name AS c FROM (SELECT n_nationkey, MAP {'r': n_regionkey, 'k': n_nationkey} AS m, {'name': n_name} AS s FROM nation)")
def map_and_struct_functions(t):
    m = F.create_map(F.lit("r"), "n_regionkey", F.lit("k"), "n_nationkey")
    return t.nation.select("n_nationkey", m.alias("m"), F.struct(F.col("n_name").alias("name")).alias("s")).select("n_nationkey", F.size(F.map_keys("m")).cast(L).alias("a"), F.col("m")["r"].alias("b"), F.col("s.name").alias("c"))


@query("""
SELECT r_regionkey, CASE WHEN r_regionkey > 2 THEN ['a', 'b'] ELSE ['b'] END AS kept, ['A', 'B'] AS keys, [r_regionkey + 1, 8] AS vals, ['a', 'b', 'c'] AS more, [7, r_regionkey] AS back, r_name AS name FROM region""")
def map_transforms(t):
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array("r_regionkey", F.lit(7)))
    back = F.map_from_entries(F.array(F.struct(F.lit("x").alias("k"), F.lit(7).alias("v")), F.struct(F.lit("y").alias("k"), F.col("r_regionkey").alias("v"))))
    return t.region.select(
        "r_regionkey",
        F.map_keys(F.map_filter(m, lambda k, v: v > 2)).alias("kept"),
        F.map_keys(F.transform_keys(m, lambda k, v: F.upper(k))).alias("keys"),
        F.map_values(F.transform_values(m, lambda k, v: v + 1)).alias("vals"),
        F.map_keys(F.map_concat(m, F.create_map(F.lit("c"), F.lit(1)))).alias("more"),
        F.map_values(back).alias("back"),
        F.named_struct(F.lit("n"), "r_name")["n"].alias("name"),
    )


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_parsed(t):
    return t.events.select(F.from_json("props", "k string").alias("p")).groupBy(F.col("p.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def variant(t):
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "string").alias("k"))


@query("SELECT r_regionkey AS k, r_name AS name, r_name AS from_json, r_name AS n, 'STRUCT<k: BIGINT>' AS schema FROM region")
def csv_and_xml_values(t):
    r = t.region.select(F.to_csv(F.struct("r_regionkey", "r_name")).alias("line"), F.to_json(F.struct("r_name")).alias("j"), F.concat(F.lit("<r><n>"), "r_name", F.lit("</n></r>")).alias("x"))
    r = r.select(F.from_csv("line", "k int, name string").alias("c"), F.json_tuple("j", "r_name").alias("name"), F.from_xml("x", "n string").alias("x"))
    return r.select("c.k", "c.name", F.col("name").alias("from_json"), "x.n", F.schema_of_json(F.lit('{"k": 1}')).alias("schema"))


@query("SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b, base64(encode(c_name)) AS c, hex(c_name) AS d, sha1(c_name) AS e FROM customer")
def hash_and_encoding_functions(t):
    n = F.col("c_name")
    return t.customer.select("c_custkey", F.md5(n).alias("a"), F.sha2(n, 256).alias("b"), F.base64(F.encode(n, "UTF-8")).alias("c"), F.hex(n).alias("d"), F.sha1(n).alias("e"))


@query("SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, url_encode(url) AS enc, url AS dec FROM pages")
def url_functions(t):
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.url_encode("url").alias("enc"), F.url_decode(F.url_encode("url")).alias("dec"))


@query()
def hash_functions(t):
    return t.pages.select("page_id", "url", F.crc32("url").alias("crc"), F.xxhash64("url").alias("xx"))
