"""Frames written as packets: bytes put together with Column expressions, so that captures of any size can be made.

Documentation addresses only. What a frame carries beyond its headers is written where other operators read it: DNS
messages (answers by compression pointer), HTTP first lines and Host, TLS hellos with a server name. Declared lengths
are the frames' own; the captured bytes may stop short of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.net import dotted_number


def u(value: Column | int, size: int) -> Column:
    """Big-endian hex digits of a number of so many bytes."""
    c = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


def text(c: Column | str) -> Column:
    return F.hex(F.encode(F.lit(c) if isinstance(c, str) else c, "UTF-8"))


def dotted(ip: Column) -> Column:
    """An address's four bytes; numbers beyond 255 are carried (net.dotted_number)."""
    digits = F.hex(dotted_number(ip))
    return F.when(F.length(digits) <= 8, F.lpad(digits, 8, "0")).when(ip.isNotNull(), F.raise_error(F.concat(F.lit("not an address of four bytes: "), ip)))


def labels(name: Column) -> Column:
    """A DNS name's labels."""
    return F.concat(F.array_join(F.transform(F.split(name, r"\."), lambda x: F.concat(u(F.length(x), 1), text(x))), ""), F.lit("00"))


def dns_payload() -> Column:
    answered = F.col("dns_answer").isNotNull()
    flags = F.when(F.col("reply"), F.lit(0x8180) + F.coalesce("rcode", F.lit(0))).otherwise(F.lit(0x0100))
    head = F.concat(u(F.col("dns_id"), 2), u(flags, 2), u(1, 2), u(answered.cast("long"), 2), u(0, 4))
    record = F.when(answered, F.concat(F.lit("C00C00010001"), u(60, 4), u(4, 2), dotted(F.col("dns_answer")))).otherwise("")
    return F.concat(head, labels(F.col("dns_name")), F.lit("00010001"), record)


def http_payload() -> Column:
    request = F.concat(F.col("http_method"), F.lit(" / HTTP/1.1\r\n"), F.when(F.coalesce("http_host", F.lit("")) != "", F.concat(F.lit("Host: "), "http_host", F.lit("\r\n"))).otherwise(""), F.lit("\r\n"))
    reply = F.concat(F.lit("HTTP/1.1 "), F.col("http_status").cast("string"), F.lit(" x\r\n\r\n"))
    return text(F.when(F.col("http_method").isNotNull(), request).otherwise(reply))


def tls_payload() -> Column:
    """A ClientHello with one cipher and the server name extension; application data where there is no name."""
    name = text(F.col("sni"))
    n = F.length("sni")
    extension = F.concat(u(0, 2), u(n + 5, 2), u(n + 3, 2), u(0, 1), u(n, 2), name)
    body = F.concat(u(0x0303, 2), F.lit("00" * 32), u(0, 1), u(2, 2), u(0x1301, 2), u(1, 1), u(0, 1), u(n + 9, 2), extension)
    hello = F.concat(u(1, 1), u(F.length(body) / 2, 3), body)
    return F.when(F.col("sni").isNotNull(), F.concat(F.lit("160301"), u(F.length(hello) / 2, 2), hello)).otherwise(F.concat(F.lit("170303"), u(32, 2), F.lit("AA" * 32)))


def packets(frames: DataFrame) -> DataFrame:
    """frames with bytes: Ethernet and IPv4 packets of TCP and UDP. TCP payload is written for segments that carry some; a
    column payload_hex, where it is there and not null, is the payload instead, and the only one where frames have no app;
    options_hex are TCP options, in words of four bytes; src_hex and dst_hex, where they are there, the addresses' bytes."""
    udp = F.col("proto") == "udp"
    given = F.col("payload_hex") if "payload_hex" in frames.columns else F.lit(None).cast("string")
    payload = F.coalesce(given, F.lit(""))
    if "app" in frames.columns:
        payload = F.when(given.isNotNull(), given).when(udp, dns_payload()).when(F.col("payload_len") <= 0, "").when(F.col("app") == "http", http_payload()).when(F.col("app") == "tls", tls_payload()).otherwise("")
    options = F.coalesce("options_hex", F.lit("")) if "options_hex" in frames.columns else F.lit("")
    rows = frames.withColumns({"payload_": payload, "options_": options})
    more = (F.length("options_") / 2).cast("long")
    size = F.when(udp, F.length("payload_") / 2).otherwise(F.greatest(F.col("payload_len"), F.length("payload_") / 2))
    tcp = F.concat(u(F.col("src_port"), 2), u(F.col("dst_port"), 2), u(F.col("seq"), 4), u(F.coalesce("ack", F.lit(0)), 4), u(0x50 + more * 4, 1), u(F.col("flags"), 1), u(F.col("win_size"), 2), F.lit("00000000"), "options_")
    datagram = F.concat(u(F.col("src_port"), 2), u(F.col("dst_port"), 2), u(size + 8, 2), F.lit("0000"))
    addresses = [F.col(f"{end}_hex") if f"{end}_hex" in frames.columns else dotted(F.col(f"{end}_ip")) for end in ("src", "dst")]
    ip = F.concat(F.lit("4500"), u(size + F.when(udp, 28).otherwise(40 + more), 2), F.lit("00010000"), u(64, 1), u(F.when(udp, 17).otherwise(6), 1), F.lit("0000"), *addresses)
    ethernet = F.lit("02005E005301" + "02005E005302" + "0800")
    return rows.withColumn("bytes", F.unhex(F.concat(ethernet, ip, F.when(udp, datagram).otherwise(tcp), "payload_"))).drop("payload_", "options_")


def cut(frames: DataFrame, at: Column, order: Column) -> DataFrame:
    """TCP segments cut into pieces: at is the array of the places where the payload (payload_hex) is cut, order the array
    of the pieces' places in capture order. Pieces get ordinals 8 * ordinal + place; frames whose `at` is null stay whole."""
    n = (F.length("payload_hex") / 2).cast("int")
    bounds = F.concat(F.array(F.lit(0)), F.coalesce(at, F.array().cast("array<int>")), F.array(n))
    pieces = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.struct(i.alias("i"), F.get(bounds, i).alias("low"), F.get(bounds, i + 1).alias("high")))
    rows = frames.withColumns({"cut_": at, "order_": order, "piece_": F.explode(F.when(at.isNotNull(), pieces).otherwise(F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("low"), n.alias("high")))))})
    p, whole = F.col("piece_"), F.col("cut_").isNull()
    return rows.withColumns(
        {
            "ordinal": 8 * F.col("ordinal") + F.when(whole, 0).otherwise(F.get("order_", p["i"])),
            "seq": F.when(whole, F.col("seq")).otherwise(F.pmod(F.col("seq") + p["low"], F.lit(1 << 32))),
            "payload_len": F.when(whole, F.col("payload_len")).otherwise(p["high"] - p["low"]),
            "payload_hex": F.when(whole, F.col("payload_hex")).otherwise(F.substring("payload_hex", 2 * p["low"] + 1, 2 * (p["high"] - p["low"]))),
        }
    ).drop("cut_", "order_", "piece_")


def fragmented(made: DataFrame, size: int, ip_id: Column) -> DataFrame:
    """packets()' rows cut into IPv4 fragments of `size` payload bytes (a multiple of 8): bytes, fragment (its number from 0)
    and fragments (how many the packet has)."""
    body = F.substring("bytes", 35, F.length("bytes"))
    count = F.ceil(F.length(body) / size).cast("int")
    rows = made.withColumns({"body_": body, "fragments": count, "fragment": F.explode(F.sequence(F.lit(0), count - 1))})
    part = F.substring("body_", (F.col("fragment") * size + 1).cast("int"), F.lit(size))
    more = (F.col("fragment") < F.col("fragments") - 1).cast("int")
    head = F.concat(F.lit("4500"), u(F.length(part) + 20, 2), u(ip_id, 2), u(more * 8192 + F.col("fragment") * (size // 8), 2))
    return rows.withColumn("bytes", F.concat(F.substring("bytes", 1, 14), F.unhex(head), F.substring("bytes", 23, 12), part)).drop("body_")


ETHERNET_HEAD = "02005E005301" + "02005E005302"


def ip4(payload: Column, proto: Column | int, src: Column, dst: Column) -> Column:
    """Hex digits of an IPv4 packet around a payload's hex digits."""
    return F.concat(F.lit("4500"), u(F.length(payload) / 2 + 20, 2), F.lit("00010000"), u(64, 1), u(proto, 1), F.lit("0000"), dotted(src), dotted(dst), payload)


def ip6(payload: Column, proto: int, src: Column, dst: Column, hop_by_hop: Column) -> Column:
    """Hex digits of an IPv6 packet; src and dst are the addresses' hex digits. hop_by_hop: whether that header is there."""
    inner = F.when(hop_by_hop, F.concat(u(proto, 1), F.lit("00" + "0104" + "00000000"), payload)).otherwise(payload)
    return F.concat(F.lit("60000000"), u(F.length(inner) / 2, 2), u(F.when(hop_by_hop, 0).otherwise(proto), 1), u(64, 1), src, dst, inner)


def ethernet(packet: Column, kind: str = "0800") -> Column:
    return F.unhex(F.concat(F.lit(ETHERNET_HEAD + kind), packet))


def icmp_error(kind: int, code: Column, packet: Column) -> Column:
    """Hex digits of an ICMP error that quotes a packet's header and eight bytes behind it."""
    return F.concat(u(kind, 1), u(code, 1), F.lit("0000" + "00000000"), F.substring(packet, 1, 56))


def tunnelled(made: DataFrame, kind: Column, src: str, dst: str) -> DataFrame:
    """packets()' rows inside a tunnel: kind 0 leaves them, 1 is IP in IP, 2 GRE, 3 VXLAN."""
    frame = F.hex("bytes")
    inner, s, d = F.substring(frame, 29, 1 << 20), F.lit(src), F.lit(dst)
    vxlan = F.concat(F.lit("C0001" + "2B5"), u(F.length(frame) / 2 + 16, 2), F.lit("0000" + "08000000" + "00002A00"), frame)
    around = F.when(kind == 1, ip4(inner, 4, s, d)).when(kind == 2, ip4(F.concat(F.lit("00000800"), inner), 47, s, d)).when(kind == 3, ip4(vxlan, 17, s, d))
    return made.withColumn("bytes", F.when(kind == 0, F.col("bytes")).otherwise(ethernet(around)))


def little(value: Column, size: int) -> Column:
    """Little-endian hex digits of a number of so many bytes."""
    return F.concat(*[u(F.floor(value / 256**i) % 256, 1) for i in range(size)])


def smb2_payload() -> Column:
    """An SMB2 header in its session packet, for rows with command, message_id, reply, and pending (an interim answer)."""
    flags = F.when(F.col("reply"), 1).otherwise(0)
    header = F.concat(F.lit("FE534D42" + "4000" + "0000"), little(F.when(F.col("pending"), 0x103).otherwise(0), 4), little(F.col("command"), 2), F.lit("0100"), little(flags, 4), F.lit("00" * 4), little(F.col("message_id"), 8), F.lit("00" * 32))
    return F.concat(F.lit("00000040"), header)


def tls_alert(level: Column, code: Column) -> Column:
    """A record of application data, then an alert."""
    return F.concat(F.lit("1703030004" + "AA" * 4 + "1503030002"), u(level, 1), u(code, 1))


def sip_payload() -> Column:
    """A SIP message of a call for rows with call, status (null in requests), method, cseq and padding."""
    first = F.when(F.col("status").isNull(), F.concat(F.col("method"), F.lit(" sip:bob@b.example SIP/2.0\r\n"))).otherwise(F.concat(F.lit("SIP/2.0 "), F.col("status").cast("string"), F.lit(" x\r\n")))
    return text(
        F.concat(first, F.lit("X-Padding: "), F.repeat(F.lit("p"), F.col("padding").cast("int")), F.lit("\r\nFrom: <sip:alice@a.example>;tag=1\r\nt: <sip:bob@b.example>\r\nCall-ID: "), "call", F.lit("\r\nCSeq: "), F.col("cseq").cast("string"), F.lit(" "), "method", F.lit("\r\n\r\n"))
    )


def rtp_payload(kind: int, sequence: Column, timestamp: Column, source: Column, size: int = 20) -> Column:
    """An RTP packet of a payload type (RFC 3550)."""
    return F.concat(F.lit("80"), u(kind, 1), u(sequence % 65536, 2), u(timestamp % (1 << 32), 4), u(source, 4), F.lit("00" * size))
