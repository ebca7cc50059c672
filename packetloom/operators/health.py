"""How the data of a TCP connection gets across: positions, bytes in flight, selective acknowledgements, goodput.

Input segments: tuple_id, way (0 or 1), ordinal, ts_us (null if untimed), seq, ack, flags, payload_len, win, shift (the
window shift that a SYN offers), sack (array of left and right edges, or null). A direction's positions count from the
first sequence number seen of it, and are trusted within half the circle. Untimed segments set bases and nothing else.

Everything but the credit of goodput is windows over a connection's segments in capture order. Goodput credits each byte
once, by the first cumulative or selective acknowledgement that covers it: a walk over a direction's acknowledged ranges
that keeps only the islands beyond the cumulative edge.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import walk
from packetloom.operators.sessions import ACK, FIN, SYN

SPACE = 1 << 32
HALF = 1 << 31
MAX_SHIFT = 14


def _place(number: Column, base: Column) -> Column:
    """Signed distance on the circle; null at the exact half."""
    d = F.pmod(number - base + HALF, F.lit(SPACE)) - HALF
    return F.when(d != -HALF, d)


def _flag(bit: int) -> Column:
    return F.col("flags").bitwiseAND(bit) != 0


def positions(segments: DataFrame) -> DataFrame:
    """Timed segments with start and end in their own direction's space, acked in the peer's, and, after each segment: sent
    and acked edges of its own direction (own_sent, own_acked) and of the peer's (peer_sent, peer_acked); in_flight of its own
    data and of the data it acknowledges, once there is an acknowledgement; offered: the window it gives the peer, scaled
    where both SYNs offered a shift (scaling: scaled, raw, or unknown)."""
    order = Window.partitionBy("tuple_id").orderBy("ordinal")  # one for all windows, so that segments are sorted once
    whole, upto = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, 0)
    base = lambda way: F.min_by(F.when(F.col("way") == way, F.col("seq")), F.when(F.col("way") == way, F.col("ordinal"))).over(whole)
    shift = lambda way: F.min_by(F.when(F.col("way") == way, F.struct("shift")), F.when((F.col("way") == way) & _flag(SYN), F.col("ordinal"))).over(whole)
    rows = segments.withColumns({"base0_": base(0), "base1_": base(1), "syn0_": shift(0), "syn1_": shift(1)}).where("ts_us IS NOT NULL")
    mine, theirs = F.when(F.col("way") == 0, F.col("base0_")).otherwise(F.col("base1_")), F.when(F.col("way") == 0, F.col("base1_")).otherwise(F.col("base0_"))
    size = F.col("payload_len") + _flag(SYN).cast("long") + _flag(FIN).cast("long")
    rows = rows.withColumns({"start": _place(F.col("seq"), mine), "peer_base": theirs, "acked": F.when(_flag(ACK), _place(F.col("ack"), theirs))})
    rows = rows.withColumn("end", F.when((size > 0) & F.col("start").isNotNull(), F.col("start") + size))
    edge = lambda way, c, by: F.max(F.when(F.col("way") == by, F.col(c))).over(upto)  # noqa: E731  the furthest so far
    rows = rows.withColumns({"sent0_": edge(0, "end", 0), "sent1_": edge(1, "end", 1), "acked0_": edge(0, "acked", 1), "acked1_": edge(1, "acked", 0)})
    side = lambda c, own: F.when((F.col("way") == 0) == F.lit(own), F.col(f"{c}0_")).otherwise(F.col(f"{c}1_"))
    rows = rows.withColumns({"own_sent": side("sent", True), "own_acked": side("acked", True), "peer_sent": side("sent", False), "peer_acked": side("acked", False)})
    both = F.col("syn0_").isNotNull() & F.col("syn1_").isNotNull()
    scaling = F.when(~both, "unknown").when(F.col("syn0_.shift").isNotNull() & F.col("syn1_.shift").isNotNull(), "scaled").otherwise("raw")
    own_shift = F.least(F.when(F.col("way") == 0, F.col("syn0_.shift")).otherwise(F.col("syn1_.shift")), F.lit(MAX_SHIFT))
    scaled = F.when((F.col("scaling") == "scaled") & ~_flag(SYN), F.col("win") * F.pow(F.lit(2), own_shift).cast("long")).otherwise(F.col("win"))
    flight = lambda c: F.greatest(F.col(f"{c}_sent") - F.col(f"{c}_acked"), F.lit(0))
    rows = rows.withColumn("scaling", scaling)
    return rows.withColumns(
        {"own_in_flight": F.when(F.col("own_acked").isNotNull() & F.col("own_sent").isNotNull(), flight("own")), "peer_in_flight": F.when(F.col("peer_acked").isNotNull() & F.col("peer_sent").isNotNull(), flight("peer")), "offered": scaled}
    ).drop("base0_", "base1_", "syn0_", "syn1_", "sent0_", "sent1_", "acked0_", "acked1_")


def sack_ranges(placed: DataFrame) -> DataFrame:
    """positions()' rows with SACK blocks -> one row a block: block (from 0), low and high in the acknowledged direction's
    space, duplicate. A first block reports a duplicate where it lies below its segment's own acknowledgement, or inside the
    second block (RFC 2883)."""
    blocks = F.transform("sack", lambda b, i: F.struct(i.alias("block"), _place(b["left"], F.col("peer_base")).alias("low"), _place(b["right"], F.col("peer_base")).alias("high")))
    rows = placed.where("sack IS NOT NULL").withColumn("blocks_", blocks)
    first, second = F.get("blocks_", F.lit(0)), F.get("blocks_", F.lit(1))
    inside = (first["low"] > F.col("acked")) & (second["low"] <= first["low"]) & (first["high"] <= second["high"])
    rows = rows.withColumns({"twice_": F.coalesce((first["high"] <= F.col("acked")) | inside, F.lit(False)), "b_": F.explode("blocks_")})
    b = F.col("b_")
    return rows.where(b["low"].isNotNull() & (b["low"] < b["high"])).select("tuple_id", (1 - F.col("way")).alias("way"), "ordinal", "ts_us", "acked", b["block"].alias("block"), b["low"].alias("low"), b["high"].alias("high"), (F.col("twice_") & (b["block"] == 0)).alias("duplicate"))


class Coverage:
    """Bytes that a range covers first. Islands beyond the cumulative edge are kept as disjoint ranges in order."""

    def __init__(self):
        self.lows: list[int] = []
        self.highs: list[int] = []

    def cover(self, low: int, high: int) -> int:
        first, last = bisect_left(self.highs, low), bisect_right(self.lows, high)
        known = sum(max(0, min(high, b) - max(low, a)) for a, b in zip(self.lows[first:last], self.highs[first:last], strict=True))
        if first < last:
            whole = min(low, self.lows[first]), max(high, self.highs[last - 1])
        else:
            whole = low, high
        self.lows[first:last], self.highs[first:last] = [whole[0]], [whole[1]]
        return high - low - known

    def add(self, r: dict) -> list[tuple]:
        fresh = self.cover(r["low"], r["high"])
        if r["cumulative"]:  # nothing below is ever asked for again
            keep = bisect_right(self.highs, r["high"] - 1)
            del self.lows[:keep], self.highs[:keep]
        return [(r["ordinal"], r["ts_us"], fresh)] if fresh else []

    def finish(self) -> list[tuple]:
        return []


def credits(placed: DataFrame) -> DataFrame:
    """(tuple_id, way, ordinal, ts_us, bytes): what each acknowledgement newly covers of a direction's data. The first
    cumulative acknowledgement of a direction sets where counting begins; duplicates are not credited."""
    order = Window.partitionBy("tuple_id", "way").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    acks = placed.where("acked IS NOT NULL").withColumn("before", F.max("acked").over(order))
    steps = acks.where("acked > before").select("tuple_id", (1 - F.col("way")).alias("way"), "ordinal", "ts_us", F.col("before").alias("low"), F.col("acked").alias("high"), F.lit(True).alias("cumulative"))
    # Blocks count from the furthest acknowledgement so far, theirs included.
    blocks = sack_ranges(placed.withColumn("acked", F.greatest("acked", "peer_acked"))).where("NOT duplicate")
    blocks = blocks.withColumn("low", F.greatest("low", "acked")).where("low < high").select("tuple_id", "way", "ordinal", "ts_us", "low", "high", F.lit(False).alias("cumulative"))
    schema = T.StructType([placed.schema["tuple_id"], T.StructField("way", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("ts_us", T.LongType()), T.StructField("bytes", T.LongType())])
    parts = walk(steps.unionByName(blocks).withColumn("later", ~F.col("cumulative")), ["tuple_id", "way"], ["ordinal", "later", "low"], Coverage, schema)
    return parts.groupBy("tuple_id", "way", "ordinal", "ts_us").agg(F.sum("bytes").alias("bytes"))


def goodput(placed: DataFrame, buckets: int = 48) -> DataFrame:
    """Credited bytes per second and direction in `buckets` equal parts of each connection's timed span; a span of zero has none."""
    span = placed.groupBy("tuple_id").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / buckets
    part = F.least(F.floor((F.col("ts_us") - F.col("lo")) / width), F.lit(buckets - 1))
    rows = credits(placed).join(span, "tuple_id")
    return rows.groupBy("tuple_id", "way", part.alias("part")).agg((F.sum("bytes") * 1e6 / F.first(width)).alias("bytes_per_s"))
