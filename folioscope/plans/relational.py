"""Generic relational checks on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import relational
from folioscope.sources.io import table

from .registry import registry

QUERIES, ORACLES, query = registry()


@query("""
SELECT e.event_id, o.o_orderkey AS last_order FROM events e
ASOF LEFT JOIN (SELECT o_custkey % 150 AS u, o_orderdate + INTERVAL 25 YEAR AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON o.u = e.user_id % 150 AND e.ts >= o.at""")
def asof_price(spark, d):
    """Each event with its user's last order (order dates moved on by 25 years)."""
    events = table(spark, d, "events").select("event_id", (F.col("user_id") % 150).alias("u"), F.col("ts").alias("at"))
    orders = table(spark, d, "orders").select((F.col("o_custkey") % 150).alias("u"), (F.col("o_orderdate") + F.expr("INTERVAL 25 YEAR")).alias("at"), "o_orderkey").groupBy("u", "at").agg(F.max("o_orderkey").alias("last_order"))
    return relational.asof(events, orders, ["u"], "at", ["last_order"]).select("event_id", "last_order")


@query("""
WITH r AS (SELECT n_nationkey, n_nationkey * 40.0 AS low, n_nationkey * 40.0 + 100 AS high FROM nation)
SELECT n_nationkey, count(*) AS n, min(p_partkey) AS first FROM part JOIN r ON p_retailprice >= low AND p_retailprice < high GROUP BY 1""")
def range_join(spark, d):
    ranges = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 40.0).alias("low"), (F.col("n_nationkey") * 40.0 + 100).alias("high"))
    rows = relational.range_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), ranges, F.col("p_retailprice"), F.col("low"), F.col("high"), 50.0)
    return rows.groupBy("n_nationkey").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""
SELECT c_custkey, 'none' AS kind FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT c_custkey, 'urgent' FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def semi_anti(spark, d):
    customers, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    none = customers.join(orders.select("c_custkey"), "c_custkey", "left_anti").withColumn("kind", F.lit("none"))
    urgent = customers.join(orders.where(F.col("o_orderpriority").startswith("1")).select("c_custkey"), "c_custkey", "left_semi").withColumn("kind", F.lit("urgent"))
    return none.unionByName(urgent)


@query("""
SELECT 'both' AS part, k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'any', k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)""")
def set_ops(spark, d):
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda name, df: df.select(F.lit(name).alias("part"), "k")
    return named("both", c.intersect(s)).union(named("customers", c.subtract(s))).union(named("any", c.union(s).distinct()))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_outer(spark, d):
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    rows = table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def topk_group(spark, d):
    rows = relational.top_per_group(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", F.col("place").cast("long"))


@query("""
SELECT c_mktsegment, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS status_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_p
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def pivot_counts(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    out = rows.groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return out.select("c_mktsegment", *[F.coalesce(s, F.lit(0)).alias(f"status_{s.lower()}") for s in "FOP"])


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(max(CASE WHEN lang = 'en' THEN n END), 0) AS BIGINT) AS english FROM c GROUP BY 1""")
def language_maps(spark, d):
    """Each source's documents by language, as a map."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    m = c.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    entries = F.array_sort(F.map_entries("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    return m.select("source", F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counts"), total.alias("total"), F.coalesce(F.try_element_at("m", F.lit("en")), F.lit(0)).alias("english"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS again FROM events")
def json_fields(spark, d):
    """JSON read by a schema, and written."""
    rows = table(spark, d, "events").withColumn("p", F.from_json("props", "k long"))
    return rows.select("event_id", (F.col("p.k") + 1).alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("again"))


_TEXT = "SELECT n_name AS nation, count(*) AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 1"


@query(_TEXT)
def sql_text(spark, d):
    """A query that is given as SQL text, over registered views."""
    from folioscope.sources.io import register

    register(spark, d, ("customer", "nation"))
    return spark.sql(_TEXT)
