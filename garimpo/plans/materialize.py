"""Cutting lineage with written tables, and spreading a scan over the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session, else (tests) an own temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(sc, "_garimpo_dir", None)
        if not folder:
            folder = sc._garimpo_dir = tempfile.mkdtemp(prefix="garimpo-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    The result has no lineage, so a lost executor re-reads files instead of recomputing, and several consumers
    share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan with fewer partitions than cores, so that a single-file table still uses the cluster.

    Tables with enough splits are returned as they are: they need no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df if have >= cores else df.repartition(cores)
