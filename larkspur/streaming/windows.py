"""Event-time windows over streams or tables: an extension, Structured Streaming throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(df: DataFrame, time: str, size: str, keys: list[str] = (), slide: str | None = None, late: str | None = None, **aggregates: Column) -> DataFrame:
    """Tumbling (or, with slide, sliding) windows; rows later than `late` behind the newest are dropped by a stream."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(F.col(time).cast("timestamp"), size, slide) if slide else F.window(F.col(time).cast("timestamp"), size)
    out = df.groupBy(w.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None, **aggregates: Column) -> DataFrame:
    """Windows that end after a gap without rows."""
    df = df.withWatermark(time, late) if late and df.isStreaming else df
    out = df.groupBy(F.session_window(F.col(time).cast("timestamp"), gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)
