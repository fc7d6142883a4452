"""Streaming twins of the ordered operators, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_progress(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The latest value of each key so far (output mode update or complete)."""
    return events.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value))


def rate_limited_stream(events: DataFrame, stream: str, ts: str, tie: str, gap_seconds: float) -> DataFrame:
    """Keep an event if it comes at least ``gap_seconds`` after the last one kept of its stream.

    Only the time of the last kept event is state.  Events are sorted within a micro-batch; one that is
    older than what its stream has already passed is late and goes.
    """
    kinds = dict(events.dtypes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["_s", tie], kind="stable")
        kept = []
        for at, number in zip(rows["_s"], rows[tie]):
            if last is None or at + 1e-6 >= last + gap_seconds:
                last = at
                kept.append((key[0], number, at))
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame(kept, columns=[stream, tie, "seconds"])

    timed = events.select(stream, tie, F.col(ts).cast("timestamp").cast("double").alias("_s"))
    return timed.groupBy(stream).applyInPandasWithState(
        step, f"{stream} {kinds[stream]}, {tie} {kinds[tie]}, seconds double", "last double", "append", GroupStateTimeout.NoTimeout
    )


def tumbling(events: DataFrame, ts: str, kind: str, value: str, length: str, late: str) -> DataFrame:
    """Counts and sums by window of event time; events later than ``late`` go."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", length), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n", "total"
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of each key: stretches without a gap as long as ``gap``."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n"
    )


def stale(heartbeats: DataFrame, key: str, ts: str, now: float, limit_seconds: float) -> DataFrame:
    """Keys whose last heartbeat is older than the limit."""
    last = heartbeats.groupBy(key).agg(F.max(ts).alias("last_heartbeat"))
    return last.filter(F.col("last_heartbeat") < now - limit_seconds)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a table in memory, and give it (for tests and small results)."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
