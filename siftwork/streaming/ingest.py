"""Structured Streaming forms: late and repeated records, newest entry per key, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T


def distinct_records(stream: DataFrame, key: str, event_time: str, delay: str = "60 days") -> DataFrame:
    """Each record once, although it is delivered again within ``delay`` of its event time.

    State is kept per key until the watermark passes; rows later than that are dropped by Spark.
    """
    return stream.filter(F.col(event_time).isNotNull()).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def newest_per_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of every key as far as the stream has come; for ``update`` or ``complete`` mode."""
    rest = [c for c in stream.columns if c != key]
    return stream.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("s")).select(key, "s.*")


def windowed_counts(stream: DataFrame, event_time: str, by: str, text: str, length: str = "7 days", delay: str = "60 days") -> DataFrame:
    """Records and blank texts per window and ``by``; append mode gives a window once it is closed."""
    w = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, length), by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.count_if(T.normalize_text(text) == "").alias("n_blank")).select(F.col("window.start").alias("start"), by, "n", "n_blank")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet folder, with its progress in ``checkpoint``; stops when the input is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
