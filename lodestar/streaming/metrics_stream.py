"""ST2: ranking metrics maintained over a stream of labelled ranking rows.

Streaming aggregation keyed by query and event-time window (``update`` mode): per key the first
positive rank, positives within the cutoff and positives in all. The window is in the key, so the
watermark drops a window's state once it is past. ``foreachBatch`` writes each batch's updated keys
under its ``batchId``; the latest row of a key is its value, so a replayed batch rewrites the same
folder (idempotent); a query's windows add up to its metrics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_metrics(spark: SparkSession, source_dir: str, schema, out_dir: str, checkpoint_dir: str,
                   depth: int = 10, watermark: str = "1 hour", window: str = "1 day", files_per_batch: int = 1) -> None:
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    agg = (rows.withWatermark("ts", watermark).groupBy("qid", F.window("ts", window).alias("w"))
           .agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first_pos"),
                F.sum(F.when((F.col("label") == 1) & (F.col("rank") <= depth), 1).otherwise(0)).alias("hits"),
                F.sum(F.col("label")).alias("n_pos")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.select("qid", F.col("w.start").alias("since"), "first_pos", "hits", "n_pos", F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(os.path.join(out_dir, f"b={batch_id}"))

    q = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint_dir) \
        .trigger(availableNow=True).start()
    q.awaitTermination()


def current_metrics(spark: SparkSession, out_dir: str, depth: int = 10) -> DataFrame:
    """Latest state per query -> MRR@depth, success@depth, recall@depth."""
    s = spark.read.parquet(out_dir)
    state = F.struct("first_pos", "hits", "n_pos")
    last = (s.groupBy("qid", "since").agg(F.max_by(state, "batch_id").alias("s")).groupBy("qid")
            .agg(F.min("s.first_pos").alias("first_pos"), F.sum("s.hits").alias("hits"), F.sum("s.n_pos").alias("n_pos")))
    return last.select(
        "qid",
        F.when(F.col("first_pos") <= depth, 1.0 / F.col("first_pos")).otherwise(0.0).alias(f"mrr_{depth}"),
        F.when(F.col("first_pos") <= depth, 1.0).otherwise(0.0).alias(f"success_{depth}"),
        F.when(F.col("n_pos") > 0, F.col("hits") / F.col("n_pos")).otherwise(0.0).alias(f"recall_{depth}"))
