"""Stream checks over several batches: bounded state, lost ends, sessions and windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from causeway.streaming import checks

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream that reads one file a batch, in the order given."""
    def make(name, batches, schema):
        folder = tmp_path / f"in-{name}"
        for number, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{number}"))
            for file in (folder / f"b{number}").glob("*.parquet"):
                stamp = 1_700_000_000 + number
                __import__("os").utime(file, (stamp, stamp))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))

    return make


def ran(spark, df, name, mode, folder):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    query.awaitTermination()
    return spark.table(name).collect(), query.recentProgress


EFFECT = "case_id string, logical_effect_key string, durability string, maximum_durable_count int, ts timestamp"


def effect(case, minute, durability="durable"):
    return (case, "k", durability, 1, T0 + dt.timedelta(minutes=minute))


def test_counts_equal_batch_and_state_is_dropped(spark, stream_of, tmp_path):
    batches = [[effect("a", 0), effect("b", 1), effect("c", 2, "attempted")], [effect("a", 5), effect("c", 6)], [effect("z", 500)], [effect("b", 505), effect("z", 506)], [effect("y", 507)]]
    stream = stream_of("effects", batches, EFFECT)
    rows, progress = ran(spark, checks.running_counts(stream, "1 hour", "10 minutes"), "counts", "update", tmp_path)
    last = {}
    for r in rows:
        last[r.case_id, r.durable_count] = (r.maximum, r.status)
    assert last == {("a", 1): (1, "satisfied"), ("a", 2): (1, "violated"), ("b", 1): (1, "satisfied"), ("c", 0): (1, "satisfied"), ("c", 1): (1, "satisfied"), ("z", 1): (1, "satisfied"), ("z", 2): (1, "violated"), ("y", 1): (1, "satisfied")}
    kept = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(kept) >= 4 and kept[-1] == 3  # a and c are gone; b, z and y are there

    near = [b[:2] for b in batches[:2]]
    rows, _ = ran(spark, checks.running_counts(stream_of("near", near, EFFECT), "1 day", "1 day"), "near", "update", tmp_path)
    final = {r.case_id: tuple(r) for r in sorted(rows, key=lambda r: r.durable_count)}
    batch = checks.durable_counts(spark.createDataFrame([r for b in near for r in b], EFFECT)).collect()
    assert final == {r.case_id: (r.case_id, r.logical_effect_key, r.durable_count, r.maximum, r.status) for r in batch}


def test_lost_ends_come_out_by_watermark(spark, stream_of, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    starts = stream_of("starts", [[("1", at(0), "x"), ("2", at(1), "y"), ("3", at(2), "z")], [("9", at(600), "w")], [("10", at(601), "w")]], "event_id string, ts timestamp, operation string")
    ends = stream_of("ends", [[("1", at(3), "ok")], [("2", at(599), "late")], [("9", at(602), "ok")]], "parent_event_id string, ts timestamp, status string")
    rows, _ = ran(spark, checks.with_timeout(starts, ends, "30 minutes"), "pairs", "append", tmp_path)
    assert {(r.event_id, r.status, r.lost) for r in rows} == {("1", "ok", False), ("2", None, True), ("3", None, True), ("9", "ok", False)}


def test_sessions_and_windows_equal_batch(spark, stream_of, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "user_id", "event_type", "ts")
    rows = [tuple(r) for r in events.orderBy("ts").limit(400).collect()]
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    end = (-1, -1, "end", rows[-1][3] + dt.timedelta(days=3))
    stream = stream_of("events", [rows[:150], rows[150:300], rows[300:], [end], [(*end[:3], end[3] + dt.timedelta(seconds=1))]], schema)
    batch = spark.createDataFrame(rows, schema)
    for name, check, own in (("sess", checks.sessions, "user_id"), ("wind", checks.status_counts, "event_type")):
        got, _ = ran(spark, check(stream), name, "append", tmp_path)
        assert sorted(tuple(r) for r in got if r[own] not in (-1, "end")) == sorted(map(tuple, check(batch).collect()))
