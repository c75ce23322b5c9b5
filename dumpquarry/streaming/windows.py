"""Windowed aggregates over event tables: the same plan for a batch table and a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """Count and sum per window and event type: start, event_type, n, total. A stream needs a watermark, after which late rows are dropped."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, watermark: str | None = None) -> DataFrame:
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Sessions per user that end after a gap: user_id, start, end, n."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def read_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def watch_dump_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the statement texts that arrive in a folder of split dumps."""
    return spark.readStream.schema("value string").option("wholetext", "true").text(folder)
