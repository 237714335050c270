"""ST1: a stream of passages to add (and pids to remove) applied to a compressed index.

``readStream`` over a folder of Parquet batch files -> ``foreachBatch``: each micro-batch is
compressed with the broadcast codec and written, with its inverted lists, to folders named by its
``batchId``. Every write overwrites its folder, so a batch that is replayed after a failure between
two writes comes out whole. Removals are tombstones with their batch: they take away what the same or an
earlier batch added, so a pid that is added again later is live.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import Codec, compress


def apply_batch(batch: DataFrame, batch_id: int, codec: Codec, index_dir: str, vec: str = "embedding") -> None:
    """Write one batch's codes, lists and removals; may be run again."""
    def folder(name):
        return os.path.join(index_dir, name, f"batch={batch_id}")

    adds = batch.filter(F.col("op") == "add").select("pid", "tok_pos", vec)
    compress(adds, codec, vec).write.mode("overwrite").parquet(folder("codes"))
    codes = batch.sparkSession.read.parquet(folder("codes"))
    codes.select("code", "pid").distinct().write.mode("overwrite").parquet(folder("lists"))
    batch.filter(F.col("op") == "remove").select("pid").distinct().write.mode("overwrite").parquet(folder("removed"))


def stream_index(spark: SparkSession, source_dir: str, schema, codec: Codec, index_dir: str, checkpoint_dir: str,
                 vec: str = "embedding", files_per_batch: int = 1) -> None:
    """Run the stream until the files present are consumed (``availableNow``).

    Source rows: ``(op 'add'|'remove', pid, tok_pos, embedding)``. Adds are compressed and written
    to ``index_dir/codes/batch=<id>`` and ``lists``; removes to ``index_dir/removed/batch=<id>``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    q = (stream.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, codec, index_dir, vec))
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def _live(spark: SparkSession, index_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(os.path.join(index_dir, table))
    removed = (spark.read.parquet(os.path.join(index_dir, "removed")).groupBy("pid").agg(F.max("batch").alias("_gone")))
    return rows.join(removed, "pid", "left").filter(F.col("_gone").isNull() | (F.col("batch") > F.col("_gone"))).drop("_gone")


def read_streamed_index(spark: SparkSession, index_dir: str) -> tuple[DataFrame, DataFrame]:
    """Codes of every applied batch minus removed ones; doclens with 0 for removed pids."""
    codes, live = spark.read.parquet(os.path.join(index_dir, "codes")), _live(spark, index_dir, "codes")
    dl = codes.select("pid").distinct().join(live.groupBy("pid").agg(F.count(F.lit(1)).cast("long").alias("n")), "pid", "left") \
        .select("pid", F.coalesce("n", F.lit(0)).cast("long").alias("doclen"))
    return live.drop("batch"), dl


def read_streamed_lists(spark: SparkSession, index_dir: str) -> DataFrame:
    """Inverted lists ``(code, pid)`` of the live passages."""
    return _live(spark, index_dir, "lists").select("code", "pid").distinct()
