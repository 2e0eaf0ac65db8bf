"""Compiled stages on streams: filters, projections and unwinding work on a streaming DataFrame as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import predicate


def event_counts(events: DataFrame, spec: dict | None = None, width: str = "1 day", late: str | None = None) -> DataFrame:
    """Counts and sums by event type and tumbling window; late gives the watermark on a stream."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if late else rows
    rows = rows.where(predicate(spec, rows)) if spec else rows
    out = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over a folder of Parquet files with the events' columns."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
