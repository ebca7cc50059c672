"""Media and signalling: RTP streams, SIP calls and messages, multicast bursts and buffers.

All of it is window functions and aggregates over each stream's, call's or group's own rows, but for the jitter of
RFC 3550, whose recurrence streams through sorted partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import walk

#: Clock rates in Hz of static payload types; 90000 for video; others are unknown (0).
CLOCK_RATES = {0: 8000, 2: 8000, 3: 8000, 4: 8000, 5: 8000, 6: 16000, 7: 8000, 8: 8000, 9: 8000, 10: 44100, 11: 44100, 12: 8000, 13: 8000, 14: 90000, 15: 8000, 16: 11025, 17: 22050, 18: 8000, 19: 8000, 25: 90000, 26: 90000, 28: 90000, 31: 90000, 32: 90000, 33: 90000, 34: 90000}
COMFORT_NOISE = (13, 19)
#: Fixed value: bytes of an IPv4 and a UDP header, which count towards a stream's bandwidth.
IP_UDP_BYTES = 28


def rtp_facts(decoded: DataFrame) -> DataFrame:
    """UDP frames with the shape of RTP: version 2, no RTCP payload type, CSRC list inside the datagram."""
    from packetloom.sources.decode import number

    at = F.col("l7").cast("int")
    first, second = number(at, 1), number(at + 1, 1)
    shape = (F.col("proto") == "udp") & (F.col("app") == "udp") & (F.col("payload_len") >= 12) & (F.floor(first / 64) == 2) & ~F.pmod(second, F.lit(128)).between(72, 76)
    shape = shape & (12 + 4 * F.pmod(first, F.lit(16)) <= F.col("payload_len"))
    return decoded.where(shape).select(
        "ordinal", "ts_ns", "src_ip", "src_port", "dst_ip", "dst_port", F.pmod(second, F.lit(128)).cast("int").alias("payload_type"), (second >= 128).alias("marker"),
        number(at + 2, 2).cast("int").alias("sequence"), number(at + 4, 4).alias("timestamp"), number(at + 8, 4).alias("ssrc"), (F.col("payload_len") + IP_UDP_BYTES).cast("long").alias("ip_bytes"),
    )


STREAM = ["src_ip", "src_port", "dst_ip", "dst_port", "ssrc"]


def _earlier(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _step(value: Column, bits: int, w: WindowSpec) -> Column:
    """How far a wrapping counter moved since the row before, in the nearer direction; 0 for a first row."""
    size = 1 << bits
    return F.coalesce(F.pmod(value - F.lag(value).over(w) + size // 2, F.lit(size)) - size // 2, F.lit(0)).cast("long")


class Jitter:
    """The interarrival jitter of RFC 3550, 6.4.1: J += (|D| - J) / 16."""

    def __init__(self):
        self.value = 0.0

    def add(self, row: dict) -> list[tuple]:
        if row["d_ms"] is not None:
            self.value += (row["d_ms"] - self.value) / 16
        return [(*(row[c] for c in PACKET), self.value)]

    def finish(self) -> list[tuple]:
        return []


PACKET = ["ordinal", "payload_type", "marker", "sequence", "place", "at_ms", "delta_ms", "skew_ms", "kbps", "rated", "regular", "in_order", "wrong_sequence"]


def rtp_packets(rtp: DataFrame) -> DataFrame:
    """Per packet of each stream: place (the sequence number unwrapped), at_ms since the stream's first packet,
    delta_ms since the last packet in timestamp order, jitter_ms, skew_ms (nominal less real time), kbps over the last
    second, and whether its number follows the largest so far. Untimed packets take no part.

    Regular packets, which deltas and jitter are reported over, are all but a stream's first, marked ones, comfort
    noise and what follows it, and packets behind the stream's timestamp."""
    w = Window.partitionBy(*STREAM).orderBy("ordinal")
    size = F.col("ip_bytes") if "ip_bytes" in rtp.columns else F.lit(0)
    rows = rtp.where("ts_ns IS NOT NULL").select(*STREAM, "ordinal", "ts_ns", "payload_type", "marker", "sequence", "timestamp", size.alias("ip_bytes"))
    rows = rows.withColumns({"step": _step(F.col("sequence"), 16, w), "stamp_step": _step(F.col("timestamp"), 32, w), "nth": F.row_number().over(w), "type_before": F.lag("payload_type").over(w), "first_ns": F.first("ts_ns").over(w)})
    rows = rows.withColumns({"place": F.first("sequence").over(w) + F.sum("step").over(w), "stamp": F.sum("stamp_step").over(w), "at_ms": (F.col("ts_ns") - F.col("first_ns")) / 1e6})
    rows = rows.withColumns({"top": F.max("place").over(_earlier(w)), "top_stamp": F.max("stamp").over(_earlier(w))})
    later = F.col("nth") > 1
    rows = rows.withColumn("in_order", ~later | (F.col("stamp") >= F.col("top_stamp")))
    rows = rows.withColumn("since", F.last(F.when(F.col("in_order"), F.col("at_ms")), ignorenulls=True).over(_earlier(w)))
    rate = F.lit(None).cast("long")
    for kind, hertz in CLOCK_RATES.items():
        rate = F.when(F.col("payload_type") == kind, F.lit(hertz)).otherwise(rate)
    delta = F.col("at_ms") - F.col("since")
    quiet = F.col("payload_type").isin(*COMFORT_NOISE) | F.col("type_before").isin(*COMFORT_NOISE)
    second = Window.partitionBy(*STREAM).orderBy("ts_ns").rangeBetween(-1_000_000_000, Window.currentRow)
    rows = rows.withColumns(
        {
            "delta_ms": F.coalesce(delta, F.lit(0.0)),
            "d_ms": F.abs(delta - (F.col("stamp") - F.col("top_stamp")) * 1000 / rate),
            "skew_ms": F.coalesce(F.col("stamp") * 1000 / rate - F.col("at_ms"), F.lit(0.0)),
            "kbps": F.sum("ip_bytes").over(second) * 8 / 1000,
            "rated": rate.isNotNull(),
            "regular": later & ~F.col("marker") & ~quiet & F.col("in_order"),
            "wrong_sequence": later & (F.col("place") != F.col("top") + 1),
        }
    )
    rows = rows.select(*STREAM, "d_ms", *PACKET)
    schema = T.StructType([*(rows.schema[c] for c in STREAM), *(rows.schema[c] for c in PACKET), T.StructField("jitter_ms", T.DoubleType())])
    return walk(rows, STREAM, ["ordinal"], Jitter, schema)


def rtp_streams(rtp: DataFrame) -> DataFrame:
    """Per stream: packets, losses against the span of sequence numbers, deltas and jitter over regular packets, and
    whether anything was out of order; payload types in the order they came up."""
    regular = lambda c: F.when(F.col("regular"), F.col(c))
    rated = F.when(F.col("regular") & F.col("rated"), F.col("jitter_ms"))
    packets = rtp_packets(rtp)
    types = packets.groupBy(*STREAM, "payload_type").agg(F.min("ordinal").alias("seen")).groupBy(*STREAM).agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "payload_type"))), lambda x: x["payload_type"]).alias("payload_types"))
    span = (F.max("place") - F.min("place") + 1).cast("long")
    totals = packets.groupBy(*STREAM).agg(
        F.min("ordinal").alias("first_ordinal"), F.count("*").alias("packets"), span.alias("expected"), (span - F.count("*")).alias("lost"), F.count_if("wrong_sequence").alias("sequence_errors"),
        F.coalesce(F.min(regular("delta_ms")), F.lit(0.0)).alias("min_delta"), F.coalesce(F.avg(regular("delta_ms")), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.max(regular("delta_ms")), F.lit(0.0)).alias("max_delta"),
        F.min(rated).alias("min_jitter"), F.avg(rated).alias("mean_jitter"), F.max(rated).alias("max_jitter"), F.max(F.col("wrong_sequence") | ~F.col("in_order")).alias("problem"),
    )
    return totals.join(types, STREAM)


def rtp_drift(packets: DataFrame) -> DataFrame:
    """Clock drift per stream of rtp_packets(): the fitted slope of skew over time, in ms over the stream's length."""
    fit = packets.where("rated").groupBy(*STREAM).agg(F.regr_slope(F.col("skew_ms"), F.col("at_ms")).alias("slope"), F.max("at_ms").alias("length_ms"))
    return fit.select(*STREAM, (F.col("slope") * F.col("length_ms")).alias("drift_ms"), (F.col("slope") * 100).alias("drift_percent"))


def reverse_streams(streams: DataFrame) -> DataFrame:
    """Pairs of streams over exactly reversed endpoints."""
    back = streams.select(F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"), F.col("ssrc").alias("reverse_ssrc"))
    return streams.join(back, ["src_ip", "src_port", "dst_ip", "dst_port"]).select(*STREAM, "reverse_ssrc")


def sip_calls(messages: DataFrame) -> DataFrame:
    """messages: call_id, ordinal, ts, method, status, cseq_method. One row per call that starts with an INVITE.

    What a call came to is what its first deciding message says: a CANCEL, or a final answer to the INVITE. An
    accepted call is complete once a BYE after that was accepted; an undecided one rings if it was answered 18x or
    19x. All of that is least ordinals, so no call's messages are gathered."""
    opened = F.min(F.when(F.col("method") == "INVITE", F.col("ordinal"))).over(Window.partitionBy("call_id"))
    rows = messages.withColumn("first_ordinal", opened).where("ordinal >= first_ordinal")
    o, status = F.col("ordinal"), F.col("status")
    answer = F.col("method").isNull() & (F.col("cseq_method") == "INVITE")
    word = (
        F.when(F.col("method") == "CANCEL", "cancelled")
        .when(answer & status.between(200, 299), "inCall")
        .when(answer & (status == 487), "cancelled")
        .when(answer & (status >= 300), F.concat(F.lit("rejected "), status.cast("string")))
    )
    goodbye = F.col("method").isNull() & (F.col("cseq_method") == "BYE") & status.between(200, 299)
    g = rows.withColumn("word", word).groupBy("call_id", "first_ordinal").agg(
        F.count("*").alias("messages"), F.min("ts").alias("start"), F.max("ts").alias("stop"),
        F.min(F.when(F.col("word").isNotNull(), F.struct(o.alias("at"), "word"))).alias("decided"),
        F.max(F.when(goodbye, o)).alias("ended"), F.count_if(answer & status.between(180, 199)).alias("rings"),
    )
    state = (
        F.when(F.col("decided").isNull(), F.when(F.col("rings") > 0, "ringing").otherwise("setup"))
        .when((F.col("decided.word") == "inCall") & (F.col("ended") > F.col("decided.at")), "completed")
        .otherwise(F.col("decided.word"))
    )
    return g.select("call_id", "first_ordinal", "messages", "start", "stop", state.alias("state"))


def sip_resent(messages: DataFrame) -> DataFrame:
    """messages with src and dst texts, cseq: per message whether it repeats one, and the setup time of an ACK in ms.

    Messages of one call and direction with one CSeq number stand together in a run. A request repeats the request
    right before it in its run (ACK and CANCEL never do), a final answer repeats the run's last final answer if that
    came right before and had its code. Setup time is counted from the last request that repeats none."""
    key = ["call_id", "src", "dst"]
    w = Window.partitionBy(*key).orderBy("ordinal")
    rows = messages.where("call_id IS NOT NULL AND cseq IS NOT NULL AND ts IS NOT NULL").select(*key, "ordinal", "method", "status", "cseq", "cseq_method", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"))
    kind = F.when(F.col("method").isNotNull(), "request").when(F.col("status") >= 200, "final").otherwise("provisional")
    starts = F.when(F.col("cseq") == F.lag("cseq").over(w), 0).otherwise(1)
    rows = rows.withColumns({"kind": kind, "starts": starts}).withColumn("run", F.sum("starts").over(w))
    in_run = Window.partitionBy(*key, "run").orderBy("ordinal")
    code = F.last(F.when(F.col("kind") == "final", F.col("status")), ignorenulls=True).over(_earlier(in_run))
    agrees = F.col("cseq_method") == F.first("cseq_method").over(in_run)
    before = F.lag("kind").over(in_run)
    rows = rows.withColumns({"agrees": agrees, "before": before, "code": code})
    follows = F.col("agrees") & (F.col("kind") == F.col("before"))
    request = F.col("kind") == "request"
    again = follows & F.when(request, ~F.col("cseq_method").isin("ACK", "CANCEL")).otherwise((F.col("kind") == "final") & (F.col("code") == F.col("status")))
    rows = rows.withColumn("resent", F.coalesce(again, F.lit(False)))
    asked = F.last(F.when(request & ~F.col("resent"), F.col("ts_us")), ignorenulls=True).over(_earlier(w))
    return rows.withColumn("asked", asked).select(*key, "ordinal", "resent", F.when(F.col("method") == "ACK", F.floor((F.col("ts_us") - F.col("asked")) / 1000)).alias("setup_ms"))


def sip_statistics(messages: DataFrame) -> DataFrame:
    """Counts by what a message is: all, resent, each request method and each answer code, and ACKs' mean setup time."""
    resent = sip_resent(messages)
    one = lambda label, n, mean=None: F.struct(label.alias("item"), n.cast("long").alias("messages"), (F.lit(None) if mean is None else mean).cast("double").alias("mean_ms"))
    kinds = messages.select(F.coalesce(F.concat(F.lit("methods/"), "method"), F.concat(F.lit("codes/"), F.col("status").cast("string"))).alias("item")).where("item IS NOT NULL")
    by = kinds.groupBy("item").agg(F.count("*").alias("messages")).withColumn("mean_ms", F.lit(None).cast("double"))
    whole = resent.agg(F.count("*").alias("n"), F.count_if("resent").alias("r"), F.avg("setup_ms").alias("s"), F.count("setup_ms").alias("k"))
    rows = whole.select(F.explode(F.array(one(F.lit("messages"), F.col("n")), one(F.lit("resent"), F.col("r")), one(F.lit("setup"), F.col("k"), F.col("s")))).alias("x")).select("x.*")
    return by.unionByName(rows)


def multicast_streams(datagrams: DataFrame, interval_ms: int = 100, burst_alarm: int = 50, buffer_alarm: int = 10_000, kbits: int = 5_000) -> DataFrame:
    """datagrams: src, dst, ordinal, rel_ns (since the capture's first frame), udp_len.

    A datagram's burst is the number of earlier ones within the interval, in whole milliseconds. The buffer drains
    at `kbits`; its level is a sum that never falls below 0, so it is the running sum of what came in less what went
    out, above the least that sum has been. Alarms count how often a bound is reached anew."""
    key = ["src", "dst"]
    w = Window.partitionBy(*key).orderBy("ordinal")
    recent = Window.partitionBy(*key).orderBy("rel_ns").rangeBetween(1 - (interval_ms + 1) * 1_000_000, -1)
    ties = F.row_number().over(Window.partitionBy(*key, "rel_ns").orderBy("ordinal")) - 1
    rows = datagrams.select(*key, "ordinal", "rel_ns", F.col("udp_len").cast("long").alias("size"))
    gone = F.floor(F.greatest(F.col("rel_ns") - F.coalesce(F.lag("rel_ns").over(w), F.lit(0)), F.lit(0)) / 1e9 * (kbits * 125.0))
    rows = rows.withColumns({"burst": F.count("*").over(recent) + ties, "change": F.col("size") - gone, "first": F.first("size").over(w)})
    rows = rows.withColumn("run", F.sum("change").over(w)).withColumn("level", F.greatest(F.col("first") + F.col("run"), F.col("run") - F.min("run").over(w)))
    anew = lambda c, bound: (F.col(c) >= bound) & ~F.coalesce(F.lag(c).over(w) >= bound, F.lit(False))
    rows = rows.withColumns({"burst_anew": anew("burst", burst_alarm), "full_anew": anew("level", buffer_alarm)})
    seconds = (F.max_by("rel_ns", "ordinal") - F.min_by("rel_ns", "ordinal")) / 1e9
    g = rows.groupBy(*key).agg(
        F.count("*").alias("packets"), F.sum("size").alias("bytes"), seconds.alias("seconds"), F.max(F.struct("burst", (-F.col("ordinal")).alias("o"), "size")).alias("peak"),
        F.count_if("burst_anew").alias("burst_alarms"), F.greatest(F.max("level"), F.first("first")).alias("max_buffer"), F.count_if("full_anew").alias("buffer_alarms"),
    )
    per = F.when(F.col("seconds") > 0, 1 / F.col("seconds")).otherwise(0.0)
    most = F.when(F.col("peak.burst") > 1, F.col("peak.burst") * 1000 / interval_ms * F.col("peak.size") * 8).otherwise(0.0)
    return g.select(*key, "packets", (F.col("packets") * per).alias("packets_per_s"), (F.col("bytes") * 8 * per).alias("avg_bps"), most.alias("max_bps"), F.greatest(F.col("peak.burst"), F.lit(1)).cast("long").alias("max_burst"), "burst_alarms", "max_buffer", "buffer_alarms")
