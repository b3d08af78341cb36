"""Running sums over a total order without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from garimpo.plans.materialize import materialize


def running_offset(df: DataFrame, order: str, value: Column, out: str = "off") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before, in order of the unique column ``order``.

    Rows are range-partitioned once and written with their partition number; each partition is summed on its own, and
    the partitions' totals (one row a partition) give where each begins.
    """
    placed = materialize(df.repartitionByRange(F.col(order)).withColumn("_v", value.cast("bigint")).withColumn("_p", F.spark_partition_id()), "placed")
    totals = placed.groupBy("_p").agg(F.sum("_v").alias("_t"))
    begins = totals.select("_p", F.coalesce(F.sum("_t").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    within = F.sum("_v").over(W.partitionBy("_p").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_v")
    return placed.withColumn(out, within).join(F.broadcast(begins), "_p").withColumn(out, F.col(out) + F.col("_b")).drop("_p", "_b", "_v")  # one row a partition


def running_rank(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """``df`` with the place, from 1, of each row in its group, in order of the column ``order`` (unique in a group).

    A group may hold any share of the rows: they are range-partitioned by (group, order), so that a large group lies in
    several partitions; each is counted on its own, and how many rows of a group the partitions before hold (one row a
    group and partition) gives where its count begins there.
    """
    placed = materialize(df.repartitionByRange(F.col(group), F.col(order)).withColumn("_rank_p", F.spark_partition_id()), "placed")
    counts = placed.groupBy(group, "_rank_p").agg(F.count(F.lit(1)).alias("_rank_t"))
    begins = counts.select(F.col(group).alias("_rank_group"), F.col("_rank_p").alias("_rank_q"), F.coalesce(F.sum("_rank_t").over(W.partitionBy(group).orderBy("_rank_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_rank_b"))
    within = F.row_number().over(W.partitionBy("_rank_p", group).orderBy(order))
    both = placed.withColumn(out, within).join(begins, (F.col("_rank_p") == F.col("_rank_q")) & F.col(group).eqNullSafe(F.col("_rank_group")))
    return both.withColumn(out, (F.col(out) + F.col("_rank_b")).cast("bigint")).drop("_rank_p", "_rank_q", "_rank_group", "_rank_b")
