"""Plain relational and event-time queries, for completeness: joins, windows, grouping sets, JSON, time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.session import table


@register(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.count("*").alias("n"))


@register(
    "nation_revenue",
    """SELECT n_name, round(sum(l_extendedprice), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def nation_revenue(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # one row per order before anything is counted distinct
    per_order = items.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(who, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("s"), 2).alias("revenue"), F.count("*").alias("orders"))


@register(
    "running_balance",
    "SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS last_three, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS n FROM events",
)
def running_balance(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.sum("value").over(w.rowsBetween(-2, 0)).alias("last_three"), F.row_number().over(w).alias("n"))


@register("event_json", "SELECT event_type, (json_extract_string(props, '$.k'))::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@register("tumbling_hours", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2")
def tumbling_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@register(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true)::INT AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, session""",
)
def event_sessions(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    fresh = F.coalesce(gap >= F.expr("INTERVAL '30' MINUTE"), F.lit(True)).cast("int")
    t = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(w))
    return t.groupBy("user_id", "session").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).drop("session")


@register("segment_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def segment_rollup(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))


@register("set_operations", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def set_operations(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "supplier").select("s_nationkey")).subtract(table(spark, sf_dir, "nation").filter("n_regionkey = 2").select("n_nationkey"))


@register("median_prices", "SELECT p_brand, median(p_retailprice) AS middle, count(*) AS n FROM part GROUP BY 1")
def median_prices(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.median("p_retailprice").alias("middle"), F.count("*").alias("n"))


@register(
    "asof_orders",
    """SELECT e.event_id, o.o_orderkey FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate""",
)
def asof_orders(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey")).select("k", "ts", F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    # one sort of both sides instead of a range join: the last order seen on the way
    w = Window.partitionBy("k").orderBy("ts", F.col("event_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w)).filter("event_id is not null").select("event_id", "o_orderkey")
