"""What travels inside connections: reassembled streams, fragments, round-trip times, request chains."""

from __future__ import annotations

from collections import deque
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import walk
from packetloom.operators.tcp_state import SPACE, SYN, offset


class Reassembler:
    """First-observed bytes of one direction, in stream order. What is ahead of a gap waits for it in a heap, on a line
    that counts on past 2**32; memory is bounded: when more than `most_bytes` or `most_runs` wait, the gap is given up and
    a new run begins behind it."""

    def __init__(self, most_bytes: int = 16 << 20, most_runs: int = 256):
        self.next: int | None = None
        self.waiting: list[tuple[int, int, bytes]] = []
        self.held = 0
        self.most_bytes, self.most_runs = most_bytes, most_runs
        self.run = 0

    def add(self, r: dict) -> list[tuple]:
        start, data = (r["seq"] + bool(r["flags"] & SYN)) % SPACE, r["payload"] or b""
        if self.next is None:
            self.next = start
        if not data:
            return []
        heappush(self.waiting, (self.next + offset(start, self.next % SPACE), r["ordinal"], data))
        self.held += len(data)
        out = self._ready()
        while len(self.waiting) > self.most_runs or self.held > self.most_bytes:
            out += self._skip()
        return out

    def _ready(self) -> list[tuple]:
        """The pieces that now follow on without a gap."""
        out = []
        while self.waiting and self.waiting[0][0] <= self.next:
            start, ordinal, data = heappop(self.waiting)
            self.held -= len(data)
            fresh = data[self.next - start :]
            if fresh:
                out.append((self.run, ordinal, fresh))
                self.next += len(fresh)
        return out

    def _skip(self) -> list[tuple]:
        self.next, self.run = self.waiting[0][0], self.run + 1
        return self._ready()

    def finish(self) -> list[tuple]:
        out = []
        while self.waiting:
            out += self._skip()
        return out


def follow(segments: DataFrame) -> DataFrame:
    """segments: tuple_id, way, ordinal, seq, flags, payload (binary) -> runs of stream bytes in order: run (a new
    one after missing bytes), ordinal, data."""
    schema = T.StructType([segments.schema["tuple_id"], segments.schema["way"], T.StructField("run", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("data", T.BinaryType())])
    return walk(segments, ["tuple_id", "way"], ["ordinal"], Reassembler, schema)


def turns(runs: DataFrame) -> DataFrame:
    """Consecutive pieces of one direction joined: a conversation in turns."""
    order = Window.partitionBy("tuple_id").orderBy("ordinal")
    new = F.coalesce(F.lag("way").over(order) != F.col("way"), F.lit(True))
    numbered = runs.withColumn("turn", F.sum(F.when(new, 1).otherwise(0)).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    return numbered.groupBy("tuple_id", "turn", "way").agg(F.aggregate(pieces, F.lit(b""), lambda a, x: F.concat(a, x["data"])).alias("data"), F.min("ordinal").alias("ordinal"))


def reassemble_fragments(fragments: DataFrame, seconds: int = 30, most: int = 64) -> DataFrame:
    """fragments: version, src_ip, dst_ip, ip_id, ip_proto, ordinal, ts, frag_offset, more, payload -> rebuilt datagrams:
    the ordinal that completes each, its data, and the ordinals that it came from (sources, by offset).

    A datagram's fragments arrive within `seconds` of one another; it must start at 0, end with a last fragment, and
    leave no hole. Fragments may overlap where they agree byte for byte; one that does not spoils the datagram."""
    key = ["version", "src_ip", "dst_ip", "ip_id", "ip_proto"]
    order = Window.partitionBy(*key).orderBy("ordinal")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.coalesce(us - F.lag(us).over(order) > seconds * 1_000_000, F.lit(False))
    rows = fragments.withColumn("era", F.sum(F.when(late, 1).otherwise(0)).over(order))
    unique = rows.groupBy(*key, "era", "frag_offset", "more", "payload").agg(F.min("ordinal").alias("ordinal"))
    # At most `most` fragments are ever put together: a datagram has no more.
    few = unique.withColumn("n", F.count("*").over(Window.partitionBy(*key, "era"))).where(F.col("n") <= most)
    end = F.col("frag_offset") + F.length("payload")
    g = few.groupBy(*key, "era").agg(F.array_sort(F.collect_list(F.struct("frag_offset", "payload", "more", F.col("ordinal").alias("at")))).alias("parts"), F.max("ordinal").alias("ordinal"), F.min(F.when(~F.col("more"), end)).alias("last"), F.max(F.when(~F.col("more"), end)).alias("last2"), F.max(end).alias("reach"))

    def put(a: Column, p: Column) -> Column:
        """a: the bytes from 0 to `at`. Known bytes must agree, new ones are appended."""
        known = F.greatest(F.least(a["at"] - p["frag_offset"], F.length(p["payload"]).cast("long")), F.lit(0)).cast("int")
        old = F.substring(a["data"], (p["frag_offset"] + 1).cast("int"), known)
        fits = (p["frag_offset"] <= a["at"]) & (old == F.substring(p["payload"], F.lit(1), known))
        fresh = F.substring(p["payload"], known + 1, F.length(p["payload"]))
        return F.struct((a["at"] + F.length(fresh)).alias("at"), F.concat(a["data"], fresh).alias("data"), (a["ok"] & fits).alias("ok"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("data"), F.lit(True).alias("ok"))
    whole = g.withColumn("w", F.aggregate("parts", start, put)).where(F.col("w.ok") & (F.col("last") == F.col("last2")) & (F.col("last") == F.col("reach")) & (F.col("w.at") == F.col("last")))
    return whole.select(*key, "ordinal", F.col("w.data").alias("data"), F.col("parts.at").alias("sources"))


class RoundTrips:
    """Times from a segment to the acknowledgement of its end; a resent range is never measured (Karn).

    A direction's segments wait in the order of their ends, which grow: only a segment beyond everything sent before is
    ever measured. An acknowledgement takes them from the left, a resent range from the right, each of them once. At most
    `most` wait; beyond that the oldest are given up."""

    def __init__(self, most: int = 65_536):
        self.open: tuple[deque, deque] = (deque(maxlen=most), deque(maxlen=most))
        self.edge: list[int | None] = [None, None]

    def add(self, r: dict) -> list[tuple]:
        way, out = r["way"], []
        size = r["payload_len"] + bool(r["flags"] & SYN) + (r["flags"] & 1)
        if size and r["seq"] is not None:
            self._sent(way, r["seq"], size, r["ts_us"], r["ordinal"])
        peer = self.edge[1 - way]
        if r["ack"] is not None and r["flags"] & 16 and peer is not None:
            upto, last = peer + offset(r["ack"], peer % SPACE), None
            while self.open[1 - way] and self.open[1 - way][0][0] <= upto:
                last = self.open[1 - way].popleft()
            if last:
                out.append((way, r["ordinal"], last[2], r["ts_us"] - last[1]))
        return out

    def _sent(self, way: int, seq: int, size: int, ts_us: int, ordinal: int) -> None:
        edge = self.edge[way]
        start = seq if edge is None else edge + offset(seq, edge % SPACE)
        waiting = self.open[way]
        if edge is not None and start < edge:
            while waiting and waiting[-1][0] > start:
                waiting.pop()
        else:
            waiting.append((start + size, ts_us, ordinal))
        self.edge[way] = start + size if edge is None else max(edge, start + size)

    def finish(self) -> list[tuple]:
        return []


def round_trips(segments: DataFrame) -> DataFrame:
    """segments: tuple_id, way, ordinal, ts_us, seq, ack, flags, payload_len; untimed ones take no part."""
    schema = T.StructType([segments.schema["tuple_id"], T.StructField("acked_by", T.IntegerType()), T.StructField("ordinal", T.LongType()), T.StructField("sent_ordinal", T.LongType()), T.StructField("rtt_us", T.LongType())])
    return walk(segments.where("ts_us IS NOT NULL"), ["tuple_id"], ["ordinal"], RoundTrips, schema)


def throughput(segments: DataFrame, buckets: int = 48) -> DataFrame:
    """Payload bits per second and direction in `buckets` equal parts of each connection's time span."""
    span = Window.partitionBy("tuple_id")
    rows = segments.where("ts_us IS NOT NULL").withColumns({"lo": F.min("ts_us").over(span), "hi": F.max("ts_us").over(span)})
    width = F.greatest((F.col("hi") - F.col("lo")) / buckets, F.lit(1.0))
    part = F.least(F.floor((F.col("ts_us") - F.col("lo")) / width), F.lit(buckets - 1))
    return rows.groupBy("tuple_id", "way", part.alias("part")).agg((F.sum("payload_len") * 8 * 1e6 / F.first(width)).alias("bits_per_s"))


def request_chain(requests: DataFrame) -> DataFrame:
    """requests: ordinal, uri, referer, location -> (referer, uri): how often one led to the other, by referer
    header or redirect. The chains themselves are these edges; no global tree is built in one task."""
    by_header = requests.where("referer IS NOT NULL AND uri IS NOT NULL").select(F.col("referer").alias("from"), F.col("uri").alias("to"))
    by_redirect = requests.where("location IS NOT NULL AND uri IS NOT NULL").select(F.col("uri").alias("from"), F.col("location").alias("to"))
    return by_header.unionByName(by_redirect).groupBy("from", "to").agg(F.count("*").alias("hits"))
