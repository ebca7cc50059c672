"""Structured Streaming twins: timelines, gap sessions, session totals, and connection events on stored state.

Event time is a frame's capture time; NTZ times are read as UTC. What a batch query gives over all input, these
give once the watermark has passed (append) or so far (update).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators import tcp_state
from packetloom.operators.sessions import with_tuple


def event_time(frames: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Timed frames with a watermark; untimed ones have no place in an event-time window."""
    return frames.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def timeline(frames: DataFrame, width: str, lateness: str = "10 minutes") -> DataFrame:
    rows = event_time(frames, lateness)
    g = rows.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("frames"), F.sum("orig_len").alias("bytes"))
    return g.select(F.col("w.start").alias("start"), "frames", "bytes")


def activity_runs(frames: DataFrame, key: str, gap: str = "2 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Runs of a key's frames without a gap longer than `gap`."""
    rows = event_time(frames, lateness)
    g = rows.groupBy(F.session_window("ts", gap).alias("w"), F.col(key)).agg(F.count("*").alias("frames"), F.sum("orig_len").alias("bytes"))
    return g.select(key, F.col("w.start").alias("start"), "frames", "bytes")


def session_totals(frames: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Totals per tuple and window of event time; a window's state goes when the watermark has passed it."""
    rows = with_tuple(event_time(frames, lateness))
    from_a = F.col("src") == F.col("a")
    g = rows.groupBy(F.window("ts", width).alias("w"), "proto", "a", "b").agg(
        F.min("ordinal").alias("first_ordinal"), F.count("*").alias("packets"), F.sum("orig_len").alias("bytes"), F.sum(F.when(from_a, F.col("orig_len")).otherwise(0)).alias("bytes_a"), F.max(F.when(F.col("flags").bitwiseAND(4) != 0, 1).otherwise(0)).alias("any_rst")
    )
    return g.select(F.col("w.start").alias("start"), "proto", "a", "b", "first_ordinal", "packets", "bytes", "bytes_a", "any_rst")


def connection_events(frames: DataFrame, idle_ms: int = 3_600_000, lateness: str = "10 minutes") -> DataFrame:
    """The events of operators.tcp_state, with the tuple's state kept between micro-batches (append mode).

    A micro-batch must hold a tuple's frames in or after the order of earlier ones, as a capture spool writes them. All
    timers run on event time, so a replay gives what the first run gave: a tuple whose last timed frame lies `idle_ms`
    behind the watermark loses its state, and what comes then starts anew at incarnation 0. Frames later than `lateness`
    are left out, as everywhere in Structured Streaming; untimed ones count where they stand."""
    columns = [c.split()[0] for c in tcp_state.EVENT_SCHEMA.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, held = (state.get[0], tcp_state.restored(state.get[1])) if state.exists else (0, tcp_state.TupleState())
        pdf = pd.concat(list(parts)).sort_values("ordinal")
        acks = [None if pd.isna(x) else int(x) for x in pdf["ack"]]
        shifts = [None if pd.isna(x) else int(x) for x in pdf["shift"]]
        rows = zip(pdf["ordinal"], pdf["way"], pdf["seq"].astype("int64"), acks, pdf["flags"], pdf["payload"], pdf["win"].fillna(0).astype("int64"), shifts, strict=True)
        out = tcp_state.walk(key[0], rows, held)
        now = pdf["ts"].max()
        last = max(last, state.getCurrentWatermarkMs(), 0 if pd.isna(now) else int(now.timestamp() * 1000))
        state.update((last, tcp_state.saved(held)))
        state.setTimeoutTimestamp(last + idle_ms)
        yield pd.DataFrame(out, columns=columns)

    rows = tcp_state.tcp_rows(frames.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness), ("ts",))
    return rows.groupBy("tuple_id").applyInPandasWithState(step, tcp_state.EVENT_SCHEMA, "last long, held string", "append", GroupStateTimeout.EventTimeTimeout)
