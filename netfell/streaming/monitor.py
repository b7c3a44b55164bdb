"""Running counts over chunks of hits that arrive as files: an extension for watching a long simulation.

Counts only add up, so late or repeated-order chunks change nothing in the end. The streaming query keeps one sum a
(graph, step, node); each batch rewrites a snapshot table from which half-widths are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HITS = "graph_id string, chunk long, step int, node int, k long"


def running_hits(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The streaming sums of k by graph, step and node over hit tables that are put in a folder."""
    stream = spark.readStream.schema(HITS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.groupBy("graph_id", "step", "node").agg(F.sum("k").alias("k"), F.max("chunk").alias("last_chunk"))


def follow(hits: DataFrame, snapshot: str, checkpoint: str):
    """Start writing each batch's complete sums to a snapshot table, all files that are there, then stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(snapshot)

    return hits.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
