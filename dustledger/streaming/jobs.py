"""Streaming jobs: feedback ingestion with dedupe and 15-minute telemetry means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from dustledger.operators.recommend import recovery_pct

FEEDBACK_SCHEMA = ("array_id long, partner_id string, cleaned_at date, pre_clean_kwh_7d double, post_clean_kwh_7d double, submitted_at timestamp")
TELEMETRY_SCHEMA = "system_id long, ts timestamp, channel string, value double"


def feedback_stream(events: DataFrame, lateness: str = "1 day", keys: Sequence[str] = ("partner_id", "array_id", "cleaned_at")) -> DataFrame:
    """Deduplicated feedback with its recovery %; a repeat within the watermark is dropped."""
    return (events.withWatermark("submitted_at", lateness).dropDuplicatesWithinWatermark(list(keys))
            .withColumn("actual_recovery_pct", recovery_pct(F.col("post_clean_kwh_7d"), F.col("pre_clean_kwh_7d"))))


def telemetry_means(readings: DataFrame, lateness: str = "1 hour", ts: str = "ts", keys: Sequence[str] = ("system_id", "channel"), value: str = "value") -> DataFrame:
    """Tumbling 15-minute means; a window is emitted once the watermark has passed it."""
    agg = (readings.withWatermark(ts, lateness).groupBy(*keys, F.window(ts, "15 minutes").alias("w"))
           .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n")))
    return agg.select(*keys, F.col("w.start").alias("slot"), "mean_value", "n")


def append_to(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append sink in Parquet; file sink and checkpoint together give exactly-once output."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
