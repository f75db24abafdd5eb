"""Tag depths of samples that arrive as files: an extension to the batch plans, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_tags(spark: SparkSession, folder: str, schema, max_files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def running_depth(tags: DataFrame) -> DataFrame:
    """Reads of each tag in each sample so far; for update mode. State is one number for each sample and tag."""
    return tags.where("sample IS NOT NULL AND hash IS NOT NULL").groupBy("sample", "enzyme", "hash").agg(F.count(F.lit(1)).alias("depth"))


def windowed_depth(tags: DataFrame, event_time: str = "extracted_at", window: str = "1 day", lateness: str = "30 days") -> DataFrame:
    """Reads and tags of each sample and window of extraction time; a window is final, and its state dropped, once tags later than ``lateness`` can't come."""
    timed = tags.withColumn("at", F.col(event_time).cast("timestamp")).withWatermark("at", lateness)
    return timed.where("sample IS NOT NULL AND hash IS NOT NULL").groupBy(F.window("at", window).alias("w"), "sample").agg(F.count(F.lit(1)).alias("reads"), F.approx_count_distinct("hash", 0.02).alias("tags")).select(F.col("w.start").alias("window_start"), "sample", "reads", "tags")


def write_running(depth: DataFrame, sink, checkpoint: str) -> StreamingQuery:
    """Passes each batch's changed depths to ``sink(batch, batch_id)``, all there is and then stop."""
    return depth.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
