"""Relational and event-time queries over the star schema: joins, roll-ups, windows. They go beyond the log and corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.plans.materialize import shared_dir
from garimpo.plans.registry import query, table
from garimpo.streaming import windows as S


@query("SELECT n.n_name, count(*)::BIGINT AS n_orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def orders_by_nation(spark, folder):
    by = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("t"))  # pre-aggregated before the joins
    c = by.join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("k").alias("n_orders"), F.round(F.sum("t"), 2).alias("total"))


@query("SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*)::BIGINT AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def lineitem_cube(spark, folder):
    d = table(spark, folder, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))
    return d.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "quantity")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, folder):
    return table(spark, folder, "customer").select("c_custkey").join(table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_parts(spark, folder):
    p = table(spark, folder, "part").select("p_brand", "p_partkey", "p_retailprice")
    return p.withColumn("k", F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).filter("k <= 3").drop("k")


@query("SELECT date_trunc('hour', ts) AS begin, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, folder):
    return S.tumbling(table(spark, folder, "events")).select(F.col("begin").cast("timestamp_ntz").alias("begin"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS begin, count(*)::BIGINT AS n FROM s GROUP BY user_id, k"
)
def event_sessions(spark, folder):
    return S.sessions(table(spark, folder, "events")).select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin"), "n")


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, folder):
    """The table read as a stream until it is used up; hourly counts from a file sink, added up."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parquet*")

    def write(batch, batch_id):
        S.tumbling(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"))
