"""Running computations over ordered frames, partitioned so that no window holds a whole capture in one task.

Capture-wide windows (previous frame, cumulative bytes) are cut into blocks of ordinals: each block is a window
of its own, and what it needs from earlier blocks comes from one small row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames in a block of a capture-wide window.
BLOCK = 65_536


def _blocked(frames: DataFrame) -> DataFrame:
    return frames.withColumn("block_", F.floor(F.col("ordinal") / BLOCK))


def deltas(frames: DataFrame) -> DataFrame:
    """delta_us: microseconds since the previous captured frame; null for the first or if either is untimed."""
    rows = _blocked(frames)
    own = Window.partitionBy("block_").orderBy("ordinal")
    last = rows.groupBy("block_").agg(F.max_by("ts", "ordinal").alias("last_ts"), F.count("*").alias("n"))
    # One row per block: small, and in block order.
    carried = last.select("block_", F.lag("last_ts").over(Window.orderBy("block_")).alias("carry_ts"))
    first = F.row_number().over(own) == 1
    joined = rows.withColumns({"prev_": F.lag("ts").over(own), "first_": first}).join(carried, "block_")
    prev = F.when(F.col("first_"), F.col("carry_ts")).otherwise(F.col("prev_"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return joined.withColumn("delta_us", micros(F.col("ts")) - micros(prev)).drop("block_", "prev_", "first_", "carry_ts")


def cumulative_bytes(frames: DataFrame, reset: Column) -> DataFrame:
    """cum_bytes: captured bytes up to and with the frame, starting anew at frames where reset holds."""
    rows = _blocked(frames).withColumn("reset_", reset)
    upto = Window.partitionBy("block_").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("segment_", F.sum(F.when(F.col("reset_"), 1).otherwise(0)).over(upto))
    inside = Window.partitionBy("block_", "segment_").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own_", F.sum("orig_len").over(inside))
    # What a block adds to the running sum: all of it, or only what follows its last reset.
    tail = rows.groupBy("block_").agg(F.max("segment_").alias("resets"), F.max_by("own_", "ordinal").alias("tail"))
    order = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("era", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(order))
    by_era = Window.partitionBy("era").orderBy("block_").rowsBetween(Window.unboundedPreceding, 0)
    tail = tail.withColumn("running", F.sum("tail").over(by_era))
    carry = tail.select("block_", F.coalesce(F.lag("running").over(Window.orderBy("block_")), F.lit(0)).alias("carry_"))
    out = rows.join(carry, "block_")
    return out.withColumn("cum_bytes", F.when(F.col("segment_") == 0, F.col("own_") + F.col("carry_")).otherwise(F.col("own_"))).drop("block_", "reset_", "segment_", "own_", "carry_")


def relative_sequence(frames: DataFrame) -> DataFrame:
    """rel_seq: sequence number from the sender's origin; a pure SYN sets a new origin."""
    sender = Window.partitionBy("proto", "src_ip", "src_port", "dst_ip", "dst_port").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    pure_syn = (F.col("flags").bitwiseAND(2) != 0) & (F.col("flags").bitwiseAND(16) == 0)
    first = F.first("seq", ignorenulls=True).over(sender)
    origin = F.coalesce(F.last(F.when(pure_syn, F.col("seq")), ignorenulls=True).over(sender), first)
    return frames.withColumn("rel_seq", F.pmod(F.col("seq") - origin, F.lit(1 << 32)))


def last_second_bits(frames: DataFrame) -> DataFrame:
    """bandwidth_bits: bits of the session's frames in the second up to and with this one; timed frames only."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    trailing = Window.partitionBy("proto", "client_ip", "client_port", "server_ip", "server_port").orderBy("us_").rangeBetween(-1_000_000, 0)
    return frames.where("ts IS NOT NULL").withColumn("us_", micros).withColumn("bandwidth_bits", F.sum(F.col("orig_len") * 8).over(trailing)).drop("us_")


def keep_prefix(frames: DataFrame, key: list[str], n: int) -> DataFrame:
    """The first n frames of each key in capture order, and how many were left out in all (omitted)."""
    w = Window.partitionBy(*key)
    ranked = frames.withColumns({"rank_": F.row_number().over(w.orderBy("ordinal")), "total_": F.count("*").over(w)})
    return ranked.where(F.col("rank_") <= n).withColumn("omitted", F.greatest(F.col("total_") - n, F.lit(0))).drop("rank_", "total_")


def gap_runs(rows: DataFrame, key: list[str], gap_seconds: float) -> DataFrame:
    """run: number of the row's run within its key; a run ends where the next start is more than gap_seconds later."""
    order = Window.partitionBy(*key).orderBy("start", "first_ordinal")
    micros = F.unix_micros(F.col("start").cast("timestamp"))
    broken = micros - F.lag(micros).over(order) > int(gap_seconds * 1_000_000)
    return rows.withColumn("run", F.sum(F.when(broken, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
