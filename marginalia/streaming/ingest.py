"""Resumable ingest and progress logs as streams over landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, per_batch: int = 200) -> StreamingQuery:
    """Load files that have come since the last run into target and stop; the checkpoint is the resumption token."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(source)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(events: DataFrame, key: str = "job_id", step: str = "step", at: str = "at") -> DataFrame:
    """The newest event of each step of a job, kept up to date as events stream in."""
    rest = [c for c in events.columns if c not in (key, step)]
    return events.groupBy(key, step).agg(F.max_by(F.struct(*rest), at).alias("latest"))


def event_windows(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by tumbling window. An addition: batch logs have no counterpart to it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
