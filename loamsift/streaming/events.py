"""Streams: the stateless stages run unchanged on them; here are keyed dedup and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_of_key(df: DataFrame, key: str, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The first row of each key; state is dropped once the watermark has passed a row's time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows and value sums per window and event type; late rows beyond the delay are left out."""
    kind = df.schema[ts].dataType.simpleString()
    source = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if df.isStreaming else df  # watermarks want zoned times
    return source.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total_value")).select(
        F.col("w.start").cast(kind).alias("window_start"), "event_type", "n_events", "total_value"
    )
