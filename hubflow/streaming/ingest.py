"""Incremental ingest of trip shards with Structured Streaming.

New CSV shards dropped into a landing folder are scanned with the fixed trip
schema, cleaned with the same rule set and feature expressions as the batch
path (all stateless, so append mode), optionally de-duplicated within a
watermark, and appended to a parquet table partitioned by the upstream split.
The checkpoint location keeps the file-source offsets, so a restarted or
failed query resumes without re-reading or losing shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hubflow.functions.cleaning import EDA_RULES, clean_trips
from hubflow.functions.features import add_features
from hubflow.schema import TRIP_SCHEMA


def clean_trip_stream(spark: SparkSession, landing: str, pattern: str = "data_part_*.csv",
                      rules=EDA_RULES, max_files_per_trigger: int | None = None,
                      timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    reader = (spark.readStream.schema(TRIP_SCHEMA).option("header", True)
              .option("timestampFormat", timestamp_format).option("timestampNTZFormat", timestamp_format))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(f"{landing.rstrip('/')}/{pattern}")
    return add_features(clean_trips(raw, rules))


def dedup_stream(df: DataFrame, keys, event_time: str = "trip_creation_time",
                 delay: str = "1 day") -> DataFrame:
    """First arrival per key wins; state is bounded by the watermark."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def start_parquet_sink(df: DataFrame, path: str, checkpoint: str, partition_by: str = "data",
                       available_now: bool = True) -> StreamingQuery:
    w = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
         .partitionBy(partition_by).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
