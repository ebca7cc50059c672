"""Time buckets: counts, gap filling, interval choice, and comparison of several predicates in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths in seconds that an axis may have; beyond the last, its whole multiples.
WIDTHS = (1, 2, 5, 10, 30, 60, 120, 300, 600, 1800, 3600)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


#: Buckets that one row of fill_gaps() makes.
FILLED_BLOCK = 65_536


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000))


def timeline(frames: DataFrame, seconds: int, oriented: str = "reply") -> DataFrame:
    """frames and bytes in both directions per bucket; untimed frames are one row with a null bucket."""
    sent = ~F.col(oriented)
    return frames.groupBy(bucket(F.col("ts"), seconds).alias("bucket")).agg(
        F.count("*").alias("frames"), F.sum("orig_len").alias("bytes"), F.sum(F.when(sent, F.col("orig_len")).otherwise(0)).alias("sent"), F.sum(F.when(~sent, F.col("orig_len")).otherwise(0)).alias("received")
    )


def coalesce_points(points: DataFrame, shift: int) -> DataFrame:
    """Neighbouring buckets joined by a power of two, so that no frame has to be counted again."""
    return points.where("bucket IS NOT NULL").groupBy(F.shiftright("bucket", shift).alias("bucket")).agg(*[F.sum(c).alias(c) for c in ("frames", "bytes", "sent", "received")])


def fill_gaps(points: DataFrame) -> DataFrame:
    """Every bucket from the first to the last; empty ones hold zeros. Buckets are made in blocks that tasks share out."""
    span = points.where("bucket IS NOT NULL").agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where("lo IS NOT NULL")
    blocks = span.select("hi", F.explode(F.sequence("lo", "hi", F.lit(FILLED_BLOCK).cast("long"))).alias("low")).repartition("low")
    every = blocks.select(F.explode(F.sequence("low", F.least(F.col("low") + FILLED_BLOCK - 1, "hi"))).alias("bucket"))
    return every.join(points, "bucket", "left").na.fill(0, ["frames", "bytes", "sent", "received"])


def plan_width(span_seconds: float, columns: int = 2_000) -> int:
    """The smallest axis width that covers the span in so many columns."""
    for w in WIDTHS:
        if span_seconds <= w * columns:
            return w
    hours = -(-int(span_seconds) // (3600 * columns))
    return 3600 * hours


def rates(points: DataFrame, seconds: int) -> DataFrame:
    return points.select("bucket", (F.col("frames") / seconds).alias("frames_per_s"), (F.col("bytes") * 8 / seconds).alias("bits_per_s"))


def compare(frames: DataFrame, seconds: int, predicates: dict[str, Column]) -> DataFrame:
    """One pass for several three-valued predicates: matches, misses, unknowns, bytes and highest ordinal each."""
    aggs = []
    for name, p in predicates.items():
        yes = F.coalesce(p, F.lit(False))
        aggs += [
            F.count_if(yes).alias(f"{name}_yes"),
            F.count_if(~F.coalesce(p, F.lit(True))).alias(f"{name}_no"),
            F.count_if(p.isNull()).alias(f"{name}_unknown"),
            F.coalesce(F.sum(F.when(yes, F.col("orig_len"))), F.lit(0)).alias(f"{name}_bytes"),
            F.max(F.when(yes, F.col("ordinal"))).alias(f"{name}_last"),
        ]
    return frames.groupBy(bucket(F.col("ts"), seconds).alias("bucket")).agg(*aggs)


def correct_time(ts: Column, anchor: str, shift_seconds: float, second: str | None = None, second_shift: float = 0.0) -> Column:
    """A constant shift, or a drift that is linear between two anchors; in whole microseconds."""
    us = micros(ts)
    if second is None:
        moved = us + int(shift_seconds * 1e6)
    else:
        a, b = micros(F.lit(anchor).cast("timestamp")), micros(F.lit(second).cast("timestamp"))
        share = (us - a) / (b - a)
        moved = us + F.round((F.lit(shift_seconds) + share * (second_shift - shift_seconds)) * 1e6).cast("long")
    return F.timestamp_micros(moved).cast("timestamp_ntz")
