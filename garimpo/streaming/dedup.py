"""Near-duplicate removal on a stream, with the kept signatures in a table.

Each micro-batch is compared with the table of signatures kept so far and resolved within itself in order of ``seq``;
what stays is appended to the output and to the table under the batch's number, so a batch that is repeated after a
failure overwrites its own part. With a ``capacity``, a batch is compared with the newest so many signatures of earlier
batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from garimpo.operators import dedup as D
from garimpo.plans.materialize import materialize


class StreamDedup:
    def __init__(self, folder: str, threshold: float = 0.8, num_perm: int = 128, rows: int = 4, seed: int = 42, n: int = 5, capacity: int | None = None):
        self.kept, self.out = f"{folder}/signatures", f"{folder}/documents"
        self.threshold, self.num_perm, self.rows, self.seed, self.n, self.capacity = threshold, num_perm, rows, seed, n, capacity

    def _before(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Signatures kept by earlier batches."""
        schema = "seq bigint, signature array<bigint>, batch int"
        place = spark._jvm.org.apache.hadoop.fs.Path(self.kept)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.createDataFrame([], "seq bigint, signature array<bigint>")
        known = spark.read.schema(schema).parquet(self.kept).filter(F.col("batch") < batch_id)
        if self.capacity is not None:
            known = known.orderBy(F.desc("batch"), F.desc("seq")).limit(self.capacity)
        return known.select("seq", "signature")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        docs = materialize(batch.select("seq", "text"), "batch")
        sigs = materialize(D.signatures(docs, self.num_perm, self.seed, self.n), "batch-signatures")
        old = D.distinct_signatures(self._before(spark, batch_id))
        bands = D.band_pairs(D._bands(sigs, self.num_perm, self.rows), D._bands(old, self.num_perm, self.rows)).distinct().withColumnsRenamed({"a": "seq", "b": "k"})
        pairs = bands.join(sigs.withColumnRenamed("signature", "a"), "seq").join(old.select(F.col("seq").alias("k"), F.col("signature").alias("b")), "k")
        seen = pairs.filter(D.signature_similarity(F.col("a"), F.col("b")) >= self.threshold).select("seq").distinct()
        fresh = materialize(sigs.join(seen, "seq", "left_anti"), "fresh")
        one = D.distinct_signatures(fresh)
        keep = materialize(D.greedy_keep(one.select("seq"), D.similar_pairs(fresh, self.threshold, self.num_perm, self.rows)), "keep")
        silent = docs.join(sigs.select("seq"), "seq", "left_anti").select("seq")
        docs.join(keep.unionByName(silent), "seq", "left_semi").write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
        fresh.join(keep, "seq", "left_semi").write.mode("overwrite").parquet(f"{self.kept}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
