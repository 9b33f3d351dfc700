"""Incremental ingestion: pages and events as streams into fact and triple tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions.text import word_count
from graphloom.sources.tables import PAGES


def page_stream(spark: SparkSession, folder: str, least_words: int = 500, lateness: str = "1 day") -> DataFrame:
    """New page records of a folder of JSON lines, each URL once within the lateness bound."""
    pages = spark.readStream.schema(PAGES).json(folder).withColumn("seen", F.to_timestamp("crawled_at"))
    useful = pages.where(word_count("text") >= least_words)
    return useful.withWatermark("seen", lateness).dropDuplicatesWithinWatermark(["url"])


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; rows later than the bound are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
