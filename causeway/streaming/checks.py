"""Structured Streaming over event logs, with the same functions in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DURABLE = ["committed", "durable"]


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events once by id: within the watermark's delay on a stream, over all of a batch."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def paired(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Operation starts with their ends (``parent_event_id``) within a time; a lost end leaves nulls."""
    a = starts.select("event_id", F.col("ts").alias("started"), "operation")
    b = ends.select("parent_event_id", F.col("ts").alias("ended"), "status")
    if starts.isStreaming:
        a, b = a.withWatermark("started", within), b.withWatermark("ended", within)
    met = (F.col("event_id") == F.col("parent_event_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    return a.join(b, met, "left_outer").select("event_id", "operation", "started", "ended", "status", ((F.unix_micros("ended") - F.unix_micros("started")) / 1000.0).alias("duration_ms"))


def durable_counts(effects: DataFrame) -> DataFrame:
    """Durable count of each logical effect, with the verdict at most once; on a stream in update mode."""
    counts = effects.groupBy("case_id", "logical_effect_key").agg(F.count_if(F.col("durability").isin(DURABLE)).alias("durable_count"), F.min("maximum_durable_count").alias("maximum"))
    return counts.withColumn("status", F.when(F.col("durable_count") > F.col("maximum"), "violated").otherwise("satisfied"))


_COUNTS = "case_id string, logical_effect_key string, durable_count long, maximum long, status string"


def _running(keep_ms: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, maximum, last = state.get if state.exists else (0, None, 0)
        if last + keep_ms < state.getCurrentWatermarkMs():  # its time was up before these rows came
            count, maximum = 0, None
        for rows in batches:
            count += int(rows["durability"].isin(DURABLE).sum())
            least = rows["maximum_durable_count"].min()
            maximum = maximum if pd.isna(least) else int(least) if maximum is None else min(maximum, int(least))
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
        state.update((count, maximum, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + keep_ms)
        status = "violated" if maximum is not None and count > maximum else "satisfied"
        yield pd.DataFrame([[*key, count, maximum, status]], columns=["case_id", "logical_effect_key", "durable_count", "maximum", "status"]).astype({"maximum": "Int64"})

    return run


def running_counts(effects: DataFrame, keep: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """:func:`durable_counts` on a stream (with ``ts``) whose state is bounded: a row for each logical effect that a batch of
    the stream touches. The count of an effect is forgotten once the watermark is ``keep`` past its last
    event, so state holds the effects of about ``keep`` and ``delay``, however long the stream runs; a
    repetition that comes later than that begins anew."""
    rows = effects.select("case_id", "logical_effect_key", "durability", "maximum_durable_count", "ts").withWatermark("ts", delay)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    return rows.groupBy("case_id", "logical_effect_key").applyInPandasWithState(_running(keep_ms), _COUNTS, "n long, maximum long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def sessions(events: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a gap."""
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first_ts"), "n")


def with_timeout(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Pairs with ``lost``: whether no end came in time. On a stream a lost end comes out when the watermark has passed its time."""
    return paired(starts, ends, within).withColumn("lost", F.col("ended").isNull())


def status_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    rows = events.withWatermark("ts", delay) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
