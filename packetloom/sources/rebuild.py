"""Frames decoded with the help of frames before them: IP datagrams from their fragments, first records of TCP
directions from several segments.

Both work as decode, keyed reassembly, decode again, and both keep ordinals: what is rebuilt stands at the frame that
completes it. Only fragments, and only directions whose first record is cut, are ever moved; all other frames keep
their places. Decoded frames are written out once, so that no filter is pushed into the decoding's expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import walk
from packetloom.operators.streams import reassemble_fragments
from packetloom.operators.tcp_state import SPACE, offset
from packetloom.plans.tables import settle
from packetloom.sources.decode import FACTS, IPV4, IPV6, RAW, applications, decode, piece

#: Bytes of a direction, and pieces waiting for a gap, that a first record may take.
RECORD_BYTES, RECORD_PIECES = 16_384, 32
#: How HTTP/1 messages begin.
HTTP_STARTS = ("GET ", "HEAD ", "POST ", "PUT ", "DELETE ", "OPTIONS ", "PATCH ", "TRACE ", "CONNECT ", "HTTP/1.")


def is_fragment() -> Column:
    return F.coalesce(F.col("more_fragments"), F.lit(False)) | (F.coalesce(F.col("frag_offset"), F.lit(0)) > 0)


def fragments(decoded: DataFrame) -> DataFrame:
    """decode()'s rows that are fragments, as streams.reassemble_fragments reads them. A fragment whose captured bytes
    stop short takes no part, so that its datagram keeps a hole."""
    whole = F.col("ip_end") <= F.length("bytes")
    version = F.when(F.col("ether_type") == IPV4, 4).when(F.col("ether_type") == IPV6, 6)
    payload = piece(F.col("l4").cast("int"), (F.col("ip_end") - F.col("l4")).cast("int"))
    rows = decoded.where(is_fragment() & whole & (F.col("ip_end") > F.col("l4")))
    return rows.select(version.alias("version"), "src_ip", "dst_ip", "ip_id", "ip_proto", "ordinal", "ts", F.col("frag_offset").cast("long").alias("frag_offset"), F.col("more_fragments").alias("more"), payload.alias("payload"))


def sequential(frames: DataFrame, seconds: int = 30) -> DataFrame:
    """decode() of frames, in which a frame that completes a fragmented datagram shows the whole datagram: its bytes are a
    bare IP packet of it, and rebuilt_from holds the ordinals of its fragments (null for all other frames). What passes the length field of a
    packet is no datagram."""
    none = F.lit(None).cast("array<long>")
    decoded = settle(decode(frames), "decoded")
    parts = decoded.where(is_fragment())
    whole = settle(reassemble_fragments(fragments(parts), seconds).where(F.length("data") <= 65_515).select("ordinal", "data", "sources"), "datagrams")
    size = F.length("data")
    hexed = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    l3 = F.col("l3").cast("int")
    v4 = F.concat(F.unhex(F.concat(F.lit("4500"), hexed(size + 20, 2), F.lit("00000000"), hexed(F.col("ttl"), 1), hexed(F.col("ip_proto"), 1), F.lit("0000"))), piece(l3 + 12, 8))
    v6 = F.concat(F.unhex(F.concat(F.lit("60000000"), hexed(size, 2), hexed(F.col("ip_proto"), 1), hexed(F.col("ttl"), 1))), piece(l3 + 8, 32))
    bare = F.when(F.col("ether_type") == IPV4, F.concat(v4, "data")).otherwise(F.concat(v6, "data"))
    done = parts.join(whole, "ordinal").withColumns({"bytes": bare, "link_type": F.lit(RAW)})
    rebuilt = decode(done.select(*frames.columns, "sources", F.col("src_mac").alias("mac_a_"), F.col("dst_mac").alias("mac_b_")))
    rebuilt = rebuilt.withColumns({"src_mac": F.col("mac_a_"), "dst_mac": F.col("mac_b_"), "rebuilt_from": F.col("sources")}).drop("sources", "mac_a_", "mac_b_")
    left = parts.join(whole.select("ordinal"), "ordinal", "left_anti").withColumn("rebuilt_from", none)
    return decoded.where(~is_fragment()).withColumn("rebuilt_from", none).unionByName(left).unionByName(rebuilt)


class FirstRecord:
    """The first record of one direction, put together from the segments from its beginning on. Given out once it is whole,
    or as far as it came; nothing when it passes its bounds (first-observed bytes win, as everywhere)."""

    def __init__(self):
        self.data: bytes | None = b""
        self.pieces: list[tuple[int, bytes]] = []
        self.grown_by: int | None = None
        self.first: int | None = None

    def add(self, r: dict) -> list[tuple]:
        if self.data is None:
            return []
        at = offset(r["seq"], r["anchor_seq"] % SPACE)
        self.first = r["ordinal"] if self.first is None else self.first
        if at + len(r["payload"]) > len(self.data) and at >= 0:
            self.pieces.append((at, r["payload"]))
            self._join(r["ordinal"])
        if len(self.data) + sum(len(p) for _, p in self.pieces) > RECORD_BYTES or len(self.pieces) > RECORD_PIECES:
            self.data = None
        elif whole(self.data):
            out, self.data = self.finish(), None
            return out
        return []

    def _join(self, ordinal: int) -> None:
        for at, piece_ in sorted(self.pieces, key=lambda p: p[0]):
            if at > len(self.data):
                break
            fresh = piece_[len(self.data) - at :]
            if fresh:
                self.data += fresh
                self.grown_by = ordinal
        self.pieces = [p for p in self.pieces if p[0] > len(self.data)]

    def finish(self) -> list[tuple]:
        """The record at the frame that brought its last bytes, if that isn't the one that began it."""
        if self.data and self.grown_by != self.first:
            return [(self.grown_by, self.data)]
        return []


def whole(data: bytes) -> bool:
    """Whether a first record ends within data: by its TLS length, or by the empty line behind HTTP headers."""
    if len(data) >= 5 and 20 <= data[0] <= 23 and data[1] == 3:
        return len(data) >= 5 + int.from_bytes(data[3:5])
    return b"\r\n\r\n" in data


def first_records(decoded: DataFrame) -> DataFrame:
    """(ordinal, l7 facts) of the frames that complete a TCP direction's first TLS or HTTP record.

    A direction's anchor is its first segment that a record can begin with. Only directions whose anchor holds less than a
    whole record are gathered, and of them only the segments within RECORD_BYTES behind it: the small table of anchors is
    joined to the segments, and Spark filters these by its keys before the shuffle."""
    l7, n = F.col("l7").cast("int"), F.col("payload_len").cast("int")
    head = F.decode(piece(l7, F.least(n, F.lit(9))), "ISO-8859-1")
    words = reduce(Column.__or__, (F.lit(w).startswith(head) | head.startswith(w) for w in HTTP_STARTS))
    begins = F.col("app").isin("tls", "http") | words | ((n < 5) & head.rlike(r"^[\x14-\x17](\x03|$)"))
    size = F.conv(F.hex(piece(l7 + 3, 2)), 16, 10).cast("int") + 5
    ends = F.when(F.col("app") == "tls", n >= size).otherwise(F.locate("\r\n\r\n", F.decode(piece(l7, n), "ISO-8859-1")) > 0)
    way = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]
    segments = decoded.where((F.col("proto") == "tcp") & (n > 0) & F.col("seq").isNotNull())
    anchors = segments.where(begins).groupBy(*way).agg(F.min_by(F.struct("ordinal", "seq", F.coalesce(ends, F.lit(False)).alias("whole")), "ordinal").alias("a"))
    anchors = anchors.where(~F.col("a.whole")).select(*way, F.col("a.ordinal").alias("anchor"), F.col("a.seq").alias("anchor_seq"))
    near = F.pmod(F.col("seq") - F.col("anchor_seq"), F.lit(SPACE)) < RECORD_BYTES
    keys = ["src_ip", "src_port", "dst_ip", "dst_port"]
    rows = segments.select(*keys, "ordinal", "seq", piece(l7, n).alias("payload")).join(anchors, keys).where((F.col("ordinal") >= F.col("anchor")) & near)
    schema = T.StructType([*(decoded.schema[k] for k in keys), T.StructField("ordinal", T.LongType()), T.StructField("data", T.BinaryType())])
    # One direction has one record: a handful of segments, however long it is.
    found = walk(rows.select(*keys, "ordinal", "seq", "anchor_seq", "payload"), keys, ["ordinal"], FirstRecord, schema)
    read = found.select("ordinal", "src_port", "dst_port", F.col("data").alias("bytes"), F.lit("tcp").alias("proto"), F.lit(0).alias("l7"), F.length("data").alias("ip_end"), F.lit(IPV4).alias("ether_type"))
    return applications(read).select("ordinal", F.struct(*FACTS).alias("first"))


def with_first_records(decoded: DataFrame) -> DataFrame:
    """decoded, in which a frame that completes a first record shows what the whole record says."""
    decoded = settle(decoded, "decoded")
    rows = decoded.join(first_records(decoded).where(F.col("first.app").isin("tls", "http")), "ordinal", "left")
    return rows.withColumns({c: F.coalesce(F.col(f"first.{c}"), F.col(c)) for c in FACTS}).drop("first")
