"""Queries of general relational coverage on the star schema: extensions, as no single operator of the inventory stands behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.plans.book import Book, Tables

BOOK = Book()
query = BOOK.query


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(t: Tables) -> DataFrame:
    return t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.round("l_quantity").cast("bigint")).alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def star_join(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return t.customer.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) GROUP BY ALL")
def semi_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.filter("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT n_name, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey")
def left_joins(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    s = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("s"))
    return t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("c", F.lit(0)).alias("customers"), F.coalesce("s", F.lit(0)).alias("suppliers"))


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", F.col("rn").cast("bigint").alias("rn"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(t: Tables) -> DataFrame:
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, o_orderkey, count(*) OVER w AS before, lag(o_orderkey) OVER w2 AS previous FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w2 AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def row_frames(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.count("*").over(w.rowsBetween(-3, -1)).alias("before"), F.lag("o_orderkey").over(w).alias("previous"))


@query("SELECT p_type, rank() OVER (ORDER BY n DESC) AS r, dense_rank() OVER (ORDER BY n DESC) AS dr FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def ranks(t: Tables) -> DataFrame:
    w = W.orderBy(F.desc("n"))  # over a few types
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).select("p_type", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def intersect_keys(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("k")).intersect(t.customer.filter("c_acctbal < 0").select("c_nationkey"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds FROM events GROUP BY user_id")
def filtered_aggregates(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.countDistinct("event_type").alias("kinds"))


@query("SELECT user_id, count(*) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 30 MINUTE GROUP BY user_id")
def sessionized(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    opened = t.events.select("user_id", "ts", F.lag("ts").over(w).alias("p")).filter("p IS NULL OR ts > p + INTERVAL 30 MINUTES")
    return opened.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT a.event_id, max(b.event_id) AS seen FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.event_id <= a.event_id WHERE a.event_type = 'purchase' GROUP BY a.event_id")
def asof_join(t: Tables) -> DataFrame:
    # The last view so far, carried forward: a window instead of a join on a range.
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = t.events.withColumn("seen", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.filter("event_type = 'purchase' AND seen IS NOT NULL").select("event_id", "seen")


@query("SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1")
def hourly_windows(t: Tables) -> DataFrame:
    return t.events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query("SELECT event_type, y2023, y2024 FROM (SELECT event_type, count(*) FILTER (year(ts) = 2023) AS y2023, count(*) FILTER (year(ts) = 2024) AS y2024 FROM events GROUP BY event_type)")
def pivoted(t: Tables) -> DataFrame:
    p = t.events.withColumn("y", F.year("ts")).groupBy("event_type").pivot("y", [2023, 2024]).agg(F.count("event_id"))
    return p.select("event_type", F.coalesce("2023", F.lit(0)).alias("y2023"), F.coalesce("2024", F.lit(0)).alias("y2024"))
