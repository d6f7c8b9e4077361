"""Structured Streaming over event tables: windows, sessions and a change feed (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.changes import log_changes


def event_stream(spark: SparkSession, folder: str, schema, max_files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream; times become timestamps for watermarks."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are left out."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def follow_changes(log: DataFrame, key: list[str], apply, checkpoint: str):
    """Each micro-batch of a change log as net changes, given to ``apply(changes, batch_id)``."""
    return log.writeStream.foreachBatch(lambda df, n: apply(log_changes(df, key, -1), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
