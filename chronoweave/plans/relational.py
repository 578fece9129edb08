"""Plain relational queries: joins, groupings, rankings, sets, time windows. Catalyst picks their strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.plans.base import query, r, table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount")).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE c_nationkey = s_nationkey GROUP BY n_name""")
def inner_join_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t("supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), r(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").where("o_totalprice > 200000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT a.event_id, count(b.event_id) AS n FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts AND b.event_id <> a.event_id GROUP BY a.event_id")
def range_join_count(spark: SparkSession, sf: str) -> DataFrame:
    """A range join on time through an equi-join on half-day buckets."""
    half = 12 * 3600 * 1_000_000
    from chronoweave.plans.base import events

    e = events(spark, sf).select("user_id", "event_id", "t", F.floor(F.col("t") / half).alias("b"))
    left = e.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"))))
    right = e.select("user_id", "b", F.col("event_id").alias("other"), F.col("t").alias("u"))
    hits = left.join(right, ["user_id", "b"]).where((F.col("u") <= F.col("t")) & (F.col("u") >= F.col("t") - half) & (F.col("other") != F.col("event_id")))
    counted = hits.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("event_id").join(counted, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT DISTINCT p_brand, p_size FROM part")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_brand", "p_size").distinct()


@query("SELECT p_brand, count(DISTINCT p_size) AS sizes, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_brand").agg(F.count_distinct("p_size").alias("sizes"), F.count_distinct("p_type").alias("types"))


_LEVELS = "coalesce(l_returnflag, '-') AS flag, coalesce(l_linestatus, '-') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY"


def _levels(rows) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("-")).alias("flag"), F.coalesce("l_linestatus", F.lit("-")).alias("status"), "n", "qty")


@query(f"SELECT {_LEVELS} ROLLUP (l_returnflag, l_linestatus)")
def rollup_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(f"SELECT {_LEVELS} CUBE (l_returnflag, l_linestatus)")
def cube_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(f"SELECT {_LEVELS} GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return _levels(table(spark, sf, "lineitem").groupingSets([[flag], [status], []], flag, status))


@query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def rankings(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    u = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.ntile(4).over(u).cast("long").alias("quarter"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", r("o_totalprice", 2).alias("price"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier")
def intersect_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def except_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("k")).subtract(o.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    from chronoweave.functions.scalars import micros

    rows = table(spark, sf, "events").groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))
    return rows.select(micros(F.col("window.start").cast("timestamp_ntz")).alias("start_us"), "event_type", "n", "total")


@query("SELECT n_name, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def pivot_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    flat = rows.groupBy("n_name").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return flat.select("n_name", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))
