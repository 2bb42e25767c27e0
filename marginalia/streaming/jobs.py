"""Jobs as a stream: one active job a key, which ends by an event or, after a time without one, by a timer.

Events are key, job_id, at, kind (start, done, failed; others are ignored). A start is taken where its key has no active job, else
nothing happens; an end counts for the active job. A job that is as old as the limit when anything else happens, or when the
watermark passes that age, has expired. Events of a key are taken by time, then job_id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SCHEMA = "key long, job_id long, created_at timestamp, ended_at timestamp, status string"
_ENDS = "key long, job_id long, created long, ended long, status string"  # times in microseconds
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Jobs(StatefulProcessor):
    """The active job of a key, as a value with a timer."""

    def __init__(self, limit_ms: int):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getValueState("active", "job_id long, created long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = before = self.active.get()  # None where there is none
        for at, job_id, kind in sorted((row[1:4] for row in rows), key=lambda r: (r[0], r[1] is None, r[1] or 0)):  # a key's events of one batch
            if held is not None and at - held[1] >= self.limit * 1000:
                yield _ended(key[0], held, held[1] + self.limit * 1000, "expired")
                held = None
            if kind == "start" and held is None:
                held = (job_id, at)
            elif kind in ("done", "failed") and held is not None:
                yield _ended(key[0], held, at, kind)
                held = None
        if held != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            if held is None:
                self.active.clear()
            else:
                self.active.update(held)
                self.handle.registerTimer(self._expiry(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.active.get()
        if held is not None and self._expiry(held) == expiredTimerInfo.getExpiryTimeInMs():
            self.active.clear()
            yield _ended(key[0], held, held[1] + self.limit * 1000, "expired")

    def _expiry(self, held) -> int:
        return -(-held[1] // 1000) + self.limit

    def close(self) -> None:
        pass


def _ended(key: int, held: tuple, at: int, status: str) -> Row:
    return Row(key=key, job_id=held[0], created=held[1], ended=at, status=status)


def job_ends(events: DataFrame, minutes: int = 15, late: str = "0 seconds") -> DataFrame:
    """(key, job_id, created_at, ended_at, status) of jobs as they end (done, failed or expired), of a stream of events.

    Keys have few events a batch, so these are rows, not a pandas frame for each key.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = events.select("key", F.unix_micros("at").alias("us"), "job_id", "kind", "at").filter("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    ends = rows.groupBy("key").transformWithState(_Jobs(minutes * 60_000), _ENDS, "Append", "EventTime")
    return ends.select("key", "job_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("ended").alias("ended_at"), "status")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, minutes: int = 15) -> StreamingQuery:
    """Append the ends of jobs to target for the event files that have come since the last run, and stop. Events of one run may
    stand in any order; those of a later run must not be older."""
    events = spark.readStream.schema("key long, job_id long, at timestamp, kind string").parquet(source)
    return job_ends(events, minutes).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
