"""Streaming ingest of records and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.records import RAW, normalized, translated


def record_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of JSON-lines files as they arrive, renamed and with dates in one form."""
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return normalized(translated(raw))


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """One row for each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str = "ts", size: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums of events in tumbling windows; later ones than `late` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet; runs until all files that are there are read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
