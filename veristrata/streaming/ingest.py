"""Streaming forms of the append-only prediction log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, ddl: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_rows(stream: DataFrame, key: str = "claim_id", ts: str = "ts", keep: str = "1 day") -> DataFrame:
    """Resume semantics: later rows of an id are dropped while its first row is younger than ``keep``, then its state expires."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key])


def label_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("label").count()


def windowed(stream: DataFrame, ts: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Extension: event counts in event-time windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
