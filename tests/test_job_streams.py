"""Jobs as a stream: one active job a key, ends by events and timers, stopped and taken up again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.operators import timeline
from marginalia.streaming import jobs

EVENT = "key long, job_id long, at timestamp, kind string"
T0 = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def plain(events, limit, until):
    """One key after the other, one event after the other."""
    out = []
    for key in {e[0] for e in events}:
        held = None
        for _, job, t, kind in sorted((e for e in events if e[0] == key), key=lambda e: (e[2], e[1])):
            if held and t - held[1] >= limit:
                out.append((key, *held, held[1] + limit, "expired"))
                held = None
            if kind == "start" and not held:
                held = (job, t)
            elif kind in ("done", "failed") and held:
                out.append((key, *held, t, kind))
                held = None
        if held and held[1] + limit <= until:
            out.append((key, *held, held[1] + limit, "expired"))
    return sorted(out)


@pytest.mark.parametrize("cuts", [[3, 9], [12], []])
def test_ends_do_not_depend_on_the_runs(spark, tmp_path, cuts):
    events = [
        (1, 10, at(0), "start"), (1, 11, at(5), "start"), (1, 12, at(9), "done"), (2, 20, at(1), "start"), (2, 21, at(16), "start"), (2, 22, at(17), "failed"), (3, 30, at(2), "start"),
        (1, 13, at(20), "done"), (1, 14, at(21), "start"), (4, 40, at(22), "start"), (4, 41, at(22), "done"), (4, 42, at(22), "start"), (5, 50, at(30), "step"), (1, 15, at(35), "start"), (1, 16, at(36), "start"), (6, 60, at(60), "start"),
    ]
    cuts = [0, *cuts, len(events)]
    ordered = sorted(events, key=lambda e: e[2])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        spark.createDataFrame([*ordered[a:b], (None, 1, at(0), "start")], EVENT).write.mode("append").parquet(str(tmp_path / "events"))
        jobs.follow(spark, str(tmp_path / "events"), str(tmp_path / "ends"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(jobs.SCHEMA).parquet(str(tmp_path / "ends")).collect()
    want = plain(events, dt.timedelta(minutes=15), at(60))
    assert sorted(tuple(r) for r in got) == want and {r[4] for r in want} == {"done", "failed", "expired"}
    assert (3, 30, at(2), at(17), "expired") in want  # nothing else ever happens to this key: a timer's work


def test_expired_jobs_of_a_table_fail(spark):
    rows = [(1, "pending", at(0)), (2, "running", at(14)), (3, "done", at(0)), (4, "running", at(1)), (5, "running", None)]
    df = spark.createDataFrame(rows, "id long, status string, created_at timestamp")
    got = {r.id: r.status for r in timeline.expired(df, F.lit(at(16.5))).collect()}
    assert got == {1: "failed", 2: "running", 3: "done", 4: "failed", 5: "running"}


def test_ids_of_a_batch_stay_whole(spark, tmp_path):
    """events reach the state as rows; in the pandas frame that each key had, a null made floats of the ids of its batch."""
    big = 2**53 + 1
    rows = [(1, big, at(0), "start"), (1, None, at(1), "done"), (1, None, at(2), "start"), (1, big + 2, at(2), "start"), (1, 5, at(3), "failed"), (2, None, at(9), None), (2, None, at(10), "start"), (3, 6, at(90), "step")]
    spark.createDataFrame(rows, EVENT).write.parquet(str(tmp_path / "events"))
    jobs.follow(spark, str(tmp_path / "events"), str(tmp_path / "ends"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.schema(jobs.SCHEMA).parquet(str(tmp_path / "ends")).orderBy("key", "created_at").collect()
    assert [tuple(r) for r in got] == [(1, big, at(0), at(1), "done"), (1, big + 2, at(2), at(3), "failed"), (2, None, at(10), at(25), "expired")]
