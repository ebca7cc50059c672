"""Frame bytes to typed facts, as Column expressions over BINARY: one projection.

Covers Ethernet with up to two VLAN tags, raw IP, loopback and both Linux cooked captures; ARP, IPv4 with options, IPv6
with its chain of extension headers; TCP, UDP, SCTP ports, ICMP; the DNS header, the TLS record header and HTTP first
lines. Anything cut short is null, and `decode_stop` says so. `through_tunnels` decodes what GRE, VXLAN and IP in IP
carry; `icmp_errors`, `tls_records`, `sip_messages` and `smb2_messages` read further facts from decoded frames. Names and
answers of DNS messages, whose compression pointers jump about, are read by a helper on Arrow batches (`with_names`).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_LOOP, ETHERNET, RAW, COOKED, LOOP, COOKED2 = 0, 1, 101, 113, 108, 276
#: IPv6 extension headers (hop by hop, routing, fragment, authentication, destination options, mobility).
EXTENSIONS = (0, 43, 44, 51, 60, 135)
GRE, IP_IN_IP, IP6_IN_IP, VXLAN_PORT = 47, 4, 41, 4789
IPV4, IPV6, ARP, VLAN, QINQ = 0x0800, 0x86DD, 0x0806, 0x8100, 0x88A8
#: Transport numbers.
TRANSPORT = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmpv6", 132: "sctp"}


#: The first line of a request: whole, or cut off by the segment's end.
REQUEST = r"^(GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH|TRACE|CONNECT) \S+(?: HTTP/1\.[01]\r\n|(?: [HTP/1.0\r]{0,9})?\z)"
#: A Host header among the first 32 header lines, before the empty line.
HOST = r"(?i)^[^\r\n]*\r\n(?:[^\r\n]+\r\n){0,31}?Host[ \t]*:[ \t]*([^\r\n]*)\r\n"


def number(at: Column | int, size: int) -> Column:
    """Big-endian unsigned number at a 0-based offset of `bytes`; null where the frame is too short."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.length("bytes") >= at + size, digits(at, size).cast("long"))


def digits(at: Column, size: int) -> Column:
    """The decimal digits of a number that is there whole."""
    return F.conv(F.hex(F.substring(F.col("bytes"), at + 1, F.lit(size))), 16, 10)


def piece(at: Column, size: Column | int) -> Column:
    return F.substring(F.col("bytes"), at + 1, F.lit(size) if isinstance(size, int) else size)


def dotted(at: Column) -> Column:
    whole = F.concat_ws(".", *[digits(at + i, 1) for i in range(4)])
    return F.when(F.length("bytes") >= at + 4, whole).otherwise(F.concat_ws(".", *[number(at + i, 1).cast("string") for i in range(3)]))


def colons(at: Column) -> Column:
    """The uncompressed spelling of an IPv6 address, as identity uses it."""
    return F.concat_ws(":", *[F.lower(F.conv(number(at + 2 * i, 2).cast("string"), 10, 16)) for i in range(8)])


def decode(frames: DataFrame) -> DataFrame:
    """frames (bytes, link_type, ...) with the columns that session and connection operators read."""
    link = F.col("link_type")
    tag1 = number(12, 2).isin(VLAN, QINQ)
    tag2 = tag1 & number(16, 2).isin(VLAN, QINQ)
    nibble = F.floor(number(0, 1) / 16)
    ether = F.when(tag2, number(20, 2)).when(tag1, number(16, 2)).otherwise(number(12, 2))
    by_version = lambda at: F.when(F.floor(number(at, 1) / 16) == 6, IPV6).when(F.floor(number(at, 1) / 16) == 4, IPV4)
    kind = (
        F.when(link == ETHERNET, ether).when(link == COOKED, number(14, 2)).when(link == COOKED2, number(0, 2))
        .when(link.isin(NULL_LOOP, LOOP), by_version(4)).when(link == RAW, F.when(nibble == 6, IPV6).when(nibble == 4, IPV4))
    )
    l3 = F.when(link == ETHERNET, F.when(tag2, 22).when(tag1, 18).otherwise(14)).when(link == COOKED, 16).when(link == COOKED2, 20).when(link.isin(NULL_LOOP, LOOP), 4).otherwise(0)
    d = frames.withColumns({"ether_type": kind, "l3": l3})
    d = d.withColumn("v6_chain", F.when(F.col("ether_type") == IPV6, extension_chain(F.col("l3"))))
    v4, v6 = F.col("ether_type") == IPV4, F.col("ether_type") == IPV6
    head = F.pmod(number(F.col("l3"), 1), F.lit(16)) * 4
    d = d.withColumns(
        {
            "l4": F.when(v4, F.col("l3") + head).when(v6, F.col("v6_chain.at")),
            "ip_proto": F.when(v4, number(F.col("l3") + 9, 1)).when(v6, F.col("v6_chain.kind").cast("long")),
            "ip_end": F.when(v4, F.col("l3") + number(F.col("l3") + 2, 2)).when(v6, F.col("l3") + 40 + number(F.col("l3") + 4, 2)),
            "ttl": F.when(v4, number(F.col("l3") + 8, 1)).when(v6, number(F.col("l3") + 7, 1)),
            "frag_offset": F.when(v4, F.pmod(number(F.col("l3") + 6, 2), F.lit(8192)) * 8).when(v6, number(F.col("v6_chain.fragment") + 2, 2).bitwiseAND(0xFFF8)),
            "more_fragments": F.when(v4, number(F.col("l3") + 6, 1).bitwiseAND(0x20) != 0).when(v6, F.coalesce(number(F.col("v6_chain.fragment") + 3, 1).bitwiseAND(1) != 0, F.lit(False))),
            "ip_id": F.when(v4, number(F.col("l3") + 4, 2)).when(v6, number(F.col("v6_chain.fragment") + 4, 4)),
            "src_mac": F.when(link == ETHERNET, mac(6)),
            "dst_mac": F.when(link == ETHERNET, mac(0)),
            "src_ip": F.when(v4, dotted(F.col("l3") + 12)).when(v6, colons(F.col("l3") + 8)).when(F.col("ether_type") == ARP, dotted(F.col("l3") + 14)),
            "dst_ip": F.when(v4, dotted(F.col("l3") + 16)).when(v6, colons(F.col("l3") + 24)).when(F.col("ether_type") == ARP, dotted(F.col("l3") + 24)),
        }
    )
    proto = F.lit(None).cast("string")
    for n, name in TRANSPORT.items():
        proto = F.when(F.col("ip_proto") == n, F.lit(name)).otherwise(proto)
    d = d.withColumn("proto", F.when(F.col("ether_type") == ARP, "arp").otherwise(proto))
    ports = F.col("proto").isin("tcp", "udp", "sctp") & (F.coalesce("frag_offset", F.lit(0)) == 0)
    l4 = F.col("l4")
    tcp, udp = F.col("proto") == "tcp", F.col("proto") == "udp"
    d = d.withColumns(
        {
            "src_port": F.when(ports, number(l4, 2)).otherwise(0).cast("int"),
            "dst_port": F.when(ports, number(l4 + 2, 2)).otherwise(0).cast("int"),
            "seq": F.when(tcp, number(l4 + 4, 4)),
            "ack": F.when(tcp, number(l4 + 8, 4)),
            "flags": F.coalesce(F.when(tcp, number(l4 + 13, 1)), F.lit(0)).cast("int"),
            "win_size": F.when(tcp, number(l4 + 14, 2)).cast("int"),
            "win_shift": F.when(tcp, tcp_option(l4 + 20, l4 + F.floor(number(l4 + 12, 1) / 16) * 4, 3, 1)).cast("int"),
            "mss": F.when(tcp, tcp_option(l4 + 20, l4 + F.floor(number(l4 + 12, 1) / 16) * 4, 2, 2)).cast("int"),
            "l7": F.when(tcp, l4 + F.floor(number(l4 + 12, 1) / 16) * 4).when(udp, l4 + 8),
            "icmp_type": F.when(F.col("proto").isin("icmp", "icmpv6"), number(l4, 1)),
            "icmp_code": F.when(F.col("proto").isin("icmp", "icmpv6"), number(l4 + 1, 1)),
        }
    )
    return applications(d.drop("v6_chain"))


#: What applications() reads from a frame's payload.
FACTS = ("dns_id", "dns_reply", "rcode", "dns_name", "dns_truncated", "dns_recursion", "http_method", "http_status", "http_host", "sni", "tls_record", "tls_handshake", "app")


def applications(d: DataFrame) -> DataFrame:
    """Frames decoded up to their transport, with what their payload (from l7 to ip_end) shows."""
    tcp, udp = F.col("proto") == "tcp", F.col("proto") == "udp"
    l7 = F.col("l7").cast("int")
    payload = F.greatest(F.col("ip_end") - F.col("l7"), F.lit(0))
    on_port = lambda *ports: F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)
    dns_port = udp & on_port(53, 5353, 5355) & (payload >= 12)
    d = d.withColumn("head_", F.when(tcp | udp, F.decode(piece(l7, payload.cast("int")), "ISO-8859-1")))
    line = F.col("head_")
    request = F.regexp_extract(line, REQUEST, 1)
    reply = F.regexp_extract(line, r"^HTTP/1\.[01] (\d{3})", 1)
    tls = tcp & number(l7, 1).between(20, 23) & (number(l7 + 1, 1) == 3)
    name = dns_name(l7 + 12)
    d = d.withColumns(
        {
            "payload_len": F.coalesce(F.when(tcp | udp, payload), F.lit(0)).cast("long"),
            "dns_id": F.when(dns_port, number(l7, 2)),
            "dns_reply": F.when(dns_port, number(l7 + 2, 1) >= 128),
            "rcode": F.when(dns_port & (number(l7 + 2, 1) >= 128), F.pmod(number(l7 + 3, 1), F.lit(16))),
            "dns_name": F.when(dns_port & (number(l7 + 4, 2) > 0), name),
            "dns_truncated": F.when(dns_port, number(l7 + 2, 1).bitwiseAND(2) != 0),
            "dns_recursion": F.when(dns_port, number(l7 + 2, 1).bitwiseAND(1) != 0),
            "http_method": F.when(tcp & (request != ""), request),
            "http_status": F.when(tcp & (reply != ""), reply.cast("int")),
            "http_host": F.when(tcp & (request != ""), F.nullif(F.trim(F.regexp_extract(line, HOST, 1)), F.lit(""))),
            "sni": F.when(tls & (number(l7, 1) == 22) & (number(l7 + 5, 1) == 1), server_name(l7 + 9)),
            "tls_record": F.when(tls, number(l7, 1)),
            "tls_handshake": F.when(tls & (number(l7, 1) == 22), number(l7 + 5, 1)),
        }
    )
    banner = F.when(line.startswith("SSH-"), "ssh").when(line.rlike(r"^220[ -].*(?i:smtp)"), "smtp").when(line.rlike(r"^220[ -].*(?i:ftp)"), "ftp").when(line.rlike(r"^\+OK "), "pop3").when(line.rlike(r"^\* OK "), "imap")
    app = (
        F.when(F.col("tls_record").isNotNull(), "tls")
        .when(F.col("http_method").isNotNull() | F.col("http_status").isNotNull(), "http")
        .when(F.col("dns_id").isNotNull(), F.when(on_port(5353), "mdns").when(on_port(5355), "llmnr").otherwise("dns"))
        .when(on_port(5060) & line.rlike(r"^(SIP/2\.0 \d{3} |[A-Z]+ sips?:\S+ SIP/2\.0\r\n)"), "sip")
        .when(tcp & (number(l7 + 4, 4) == 0xFE534D42), "smb2")
        .when(tcp & banner.isNotNull(), banner)
        .when(udp & (F.col("payload_len") >= 20) & (number(l7 + 4, 4) == 0x2112A442), "stun")
        .when(udp & ((F.col("src_port") == 443) | (F.col("dst_port") == 443)) & (number(l7, 1) >= 192), "quic")
        .otherwise(F.col("proto"))
    )
    stop = F.when(F.col("ether_type").isNull() & F.col("bytes").isNotNull(), "malformed").when(F.col("ip_end") > F.length("bytes"), "cutShort")
    return d.withColumns({"app": app, "decode_stop": stop}).drop("head_")


def mac(at: int) -> Column:
    return F.concat_ws(":", *[F.lower(F.hex(F.substring(F.col("bytes"), at + i + 1, 1))) for i in range(6)])


def extension_chain(l3: Column, most: int = 8) -> Column:
    """kind and place (at) of what follows an IPv6 packet's extension headers, and the fragment header's place, if any."""
    start = F.struct(number(l3 + 6, 1).cast("int").alias("kind"), (l3 + 40).cast("int").alias("at"), F.lit(None).cast("int").alias("fragment"))

    def step(a: Column, _: Column) -> Column:
        more = a["kind"].isin(*EXTENSIONS)
        size = F.when(a["kind"] == 44, 8).when(a["kind"] == 51, (byte(a["at"] + 1) + 2) * 4).otherwise((byte(a["at"] + 1) + 1) * 8)
        return F.when(more, F.struct(byte(a["at"]).alias("kind"), (a["at"] + size).cast("int").alias("at"), F.when(a["kind"] == 44, a["at"]).otherwise(a["fragment"]).alias("fragment"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)


def tunnel(decoded: DataFrame) -> DataFrame:
    """decode()'s rows with inner_at and inner_link: where a packet that this one carries begins, null if it carries none."""
    l4 = F.col("l4").cast("int")
    flags, kind = number(l4, 2), number(l4 + 2, 2)
    gre = 4 + F.when(flags >= 0x8000, 4).otherwise(0) + F.when(flags.bitwiseAND(0x2000) != 0, 4).otherwise(0) + F.when(flags.bitwiseAND(0x1000) != 0, 4).otherwise(0)
    vxlan = (F.col("proto") == "udp") & (F.col("dst_port") == VXLAN_PORT) & (F.col("payload_len") >= 22) & (number(F.col("l7").cast("int"), 1).bitwiseAND(8) != 0)
    is_gre = (F.col("ip_proto") == GRE) & (flags.bitwiseAND(7) == 0)
    at = F.when(F.col("ip_proto").isin(IP_IN_IP, IP6_IN_IP), l4).when(is_gre & kind.isin(IPV4, IPV6, 0x6558), l4 + gre).when(vxlan, F.col("l7") + 8)
    whole = (F.coalesce(F.col("frag_offset"), F.lit(0)) == 0) & ~F.coalesce("more_fragments", F.lit(False))
    rows = decoded.withColumns({"inner_at": F.when(whole, at).cast("int"), "inner_link": F.when(vxlan | (is_gre & (kind == 0x6558)), ETHERNET).otherwise(RAW).cast("int")})
    sound = F.when(F.col("inner_link") == RAW, F.floor(number(F.col("inner_at"), 1) / 16).isin(4, 6)).otherwise(number(F.col("inner_at") + 12, 2).isin(IPV4, IPV6, VLAN, QINQ))
    return rows.withColumn("inner_at", F.when(sound, F.col("inner_at")))


def through_tunnels(frames: DataFrame, depth: int = 4) -> DataFrame:
    """Each frame decoded at its innermost packet, at most `depth` tunnels deep; outer_ips: the (source, destination) pairs
    of the packets around it, outermost first. Every level is written out once, so that no level's work is done twice."""
    from packetloom.plans.tables import settle

    names, out = frames.columns, None
    level = frames.withColumn("outer_ips", F.array().cast("array<struct<src:string,dst:string>>"))
    for _ in range(depth):
        rows = settle(tunnel(decode(level)), "level")
        plain = rows.where("inner_at IS NULL").drop("inner_at", "inner_link")
        out = plain if out is None else out.unionByName(plain)
        inner = F.substring("bytes", F.col("inner_at") + 1, F.greatest(F.col("ip_end") - F.col("inner_at"), F.lit(0)).cast("int"))
        path = F.concat("outer_ips", F.array(F.struct(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"))))
        made = {"bytes": inner, "link_type": F.col("inner_link")}
        level = settle(rows.where("inner_at IS NOT NULL").select(*[made.get(c, F.col(c)).alias(c) for c in names], path.alias("outer_ips")), "carried")
        if level.isEmpty():
            return out
    return out.unionByName(decode(level))


def icmp_errors(decoded: DataFrame) -> DataFrame:
    """ICMP messages with what findings.icmp_findings reads; quoted_session: the flow in the packet that an error quotes."""
    from packetloom.operators.sessions import TUPLE, with_tuple

    def session(rows: DataFrame) -> DataFrame:
        return with_tuple(rows).withColumn("session_id", F.concat_ws("|", "proto", F.col("a.ip"), F.col("a.port").cast("string"), F.col("b.ip"), F.col("b.port").cast("string"))).drop("a", "b", "src", "dst")

    assert len(TUPLE) == 3
    icmp = session(decoded.where("icmp_type IS NOT NULL AND src_ip IS NOT NULL")).select("ordinal", "session_id", F.when(F.col("proto") == "icmp", 4).otherwise(6).alias("version"), F.col("icmp_type").cast("int").alias("type"), F.col("icmp_code").cast("int").alias("code"), "bytes", "l4")
    error = F.when(F.col("version") == 4, F.col("type").isin(3, 4, 5, 11, 12)).otherwise(F.col("type") < 128)
    quoted = icmp.where(error).select("ordinal", F.substring("bytes", (F.col("l4") + 9).cast("int"), F.length("bytes")).alias("bytes"), F.lit(RAW).alias("link_type"))
    flows = session(decode(quoted).where("src_ip IS NOT NULL AND proto IS NOT NULL")).select("ordinal", F.col("session_id").alias("quoted_session"))
    return icmp.drop("bytes", "l4").join(flows, "ordinal", "left")


def icmp_echoes(decoded: DataFrame) -> DataFrame:
    """Echo requests and replies as pairing reads them: ordinal, ts, src_ip, dst_ip, ident, sequence, reply; ends is the pair of
    addresses in order, which with ident and sequence names an exchange."""
    l4, six = F.col("l4").cast("int"), F.col("proto") == "icmpv6"
    echo = F.when(six, F.col("icmp_type").isin(128, 129)).otherwise(F.col("icmp_type").isin(0, 8)) & (F.col("icmp_code") == 0)
    rows = decoded.where(F.col("proto").isin("icmp", "icmpv6") & echo)
    return rows.select("ordinal", "ts", "src_ip", "dst_ip", F.array_sort(F.array("src_ip", "dst_ip")).alias("ends"), number(l4 + 4, 2).alias("ident"), number(l4 + 6, 2).alias("sequence"), F.col("icmp_type").isin(0, 129).alias("reply"))


#: Fixed value: the random field of a ServerHello that asks to try again (RFC 8446, 4.1.3).
RETRY_RANDOM = "CF21AD74E59A6111BE1D8C021E65B891C2A211167ABB8C5E079E09E2C8A8339C"


def tls_records(decoded: DataFrame, most: int = 32) -> DataFrame:
    """TLS records that begin in a frame, as findings.tls_findings reads them: session_id, ordinal, way, record (alert,
    clientHello, serverHello, helloRetry, other), level, code, version."""
    from packetloom.operators.sessions import with_tuple

    end = F.col("ip_end").cast("int")
    start = F.struct(F.col("l7").cast("int").alias("at"), F.array().cast("array<int>").alias("found"))

    def step(a: Column, _: Column) -> Column:
        fits = byte(a["at"]).between(20, 23) & (byte(a["at"] + 1) == 3) & (a["at"] + 5 <= end)
        size = byte(a["at"] + 3) * 256 + byte(a["at"] + 4)
        return F.when(F.coalesce(fits, F.lit(False)), F.struct((a["at"] + 5 + size).alias("at"), F.concat(a["found"], F.array(a["at"])).alias("found"))).otherwise(a)

    places = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda a: a["found"])
    rows = with_tuple(decoded.where("app = 'tls' AND src_ip IS NOT NULL"))
    rows = rows.select("ordinal", "bytes", F.concat_ws("|", "proto", F.col("a.ip"), F.col("a.port").cast("string"), F.col("b.ip"), F.col("b.port").cast("string")).alias("session_id"), F.when(F.col("src") == F.col("a"), 0).otherwise(1).alias("way"), F.explode(places).alias("r"))
    r = F.col("r")
    kind, message, size = byte(r), byte(r + 5), byte(r + 3) * 256 + byte(r + 4)
    retry = F.hex(F.substring("bytes", r + 12, F.lit(32))) == RETRY_RANDOM
    record = F.when((kind == 21) & (size == 2), "alert").when((kind == 22) & (message == 1), "clientHello").when((kind == 22) & (message == 2), F.when(retry, "helloRetry").otherwise("serverHello")).otherwise("other")
    rows = rows.withColumn("record", record)
    alert, hello = F.col("record") == "alert", F.col("record").isin("serverHello", "helloRetry")
    # A version above 1.2 is in an extension (43); the field before it then says 1.2.
    body = r + 9 + 34
    extensions = body + 1 + byte(body) + 3
    listed = F.coalesce(byte(extensions) * 256 + byte(extensions + 1), F.lit(0))
    chosen = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.floor(listed / 4).cast("int"), F.lit(1))), F.struct((extensions + 2).alias("at"), F.lit(None).cast("int").alias("v")),
        lambda a, _: F.struct((a["at"] + 4 + byte(a["at"] + 2) * 256 + byte(a["at"] + 3)).alias("at"), F.coalesce(a["v"], F.when(byte(a["at"]) * 256 + byte(a["at"] + 1) == 43, byte(a["at"] + 4) * 256 + byte(a["at"] + 5))).alias("v")), lambda a: a["v"],
    )
    version = F.when(hello, F.coalesce(chosen, byte(r + 9) * 256 + byte(r + 10)))
    return rows.select("session_id", "ordinal", "way", "record", F.when(alert, byte(r + 5)).alias("level"), F.when(alert, byte(r + 6)).alias("code"), version.alias("version"))


def payload_text() -> Column:
    """A frame's payload as text, one character a byte."""
    return F.decode(piece(F.col("l7").cast("int"), F.col("payload_len").cast("int")), "ISO-8859-1")


def sip_messages(decoded: DataFrame) -> DataFrame:
    """SIP messages as media.sip_calls and media.sip_resent read them."""
    text = payload_text()
    header = lambda *names: F.nullif(F.regexp_extract(text, rf"(?im)^(?:{'|'.join(names)})[ \t]*:[ \t]*([^\r\n]*)", 1), F.lit(""))
    cseq = header("CSeq")
    return decoded.where("app = 'sip'").select(
        "ordinal", "ts", header("Call-ID", "i").alias("call_id"), F.nullif(F.regexp_extract(text, r"^([A-Z]+) sips?:", 1), F.lit("")).alias("method"), F.regexp_extract(text, r"^SIP/2\.0 (\d{3})", 1).try_cast("int").alias("status"),
        F.regexp_extract(cseq, r"^(\d+)", 1).try_cast("bigint").alias("cseq"), F.nullif(F.regexp_extract(cseq, r"^\d+\s+(\w+)", 1), F.lit("")).alias("cseq_method"),
        F.concat_ws(":", "src_ip", F.col("src_port").cast("string")).alias("src"), F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")).alias("dst"),
        F.nullif(F.regexp_extract(header("From", "f"), r"<?(sips?:[^>;\s]+)", 1), F.lit("")).alias("from_uri"), F.nullif(F.regexp_extract(header("To", "t"), r"<?(sips?:[^>;\s]+)", 1), F.lit("")).alias("to_uri"),
    )


def little(at: Column, size: int) -> Column:
    """Little-endian unsigned number."""
    return sum((byte(at + i).cast("long") * 256**i for i in range(1, size)), byte(at).cast("long"))


def smb2_messages(decoded: DataFrame) -> DataFrame:
    """SMB2 headers as pairing reads them: ordinal, ts, endpoints, command, message_id, reply, interim (a pending answer)."""
    at = F.col("l7").cast("int") + 4
    reply = little(at + 16, 4).bitwiseAND(1) != 0
    return decoded.where("app = 'smb2'").select("ordinal", "ts", "src_ip", "src_port", "dst_ip", "dst_port", little(at + 12, 2).cast("int").alias("command"), little(at + 24, 8).alias("message_id"), reply.alias("reply"), (reply & (little(at + 8, 4) == 0x103)).alias("interim"))


def dns_message(data: bytes, most: int = 64) -> tuple[str | None, list[str]]:
    """The first name asked or answered for, and the addresses in the answers (at most so many records are read)."""

    def name(at: int) -> tuple[str | None, int]:
        labels, after, jumps = [], None, 0
        while at < len(data):
            size = data[at]
            if size >= 0xC0:
                if at + 1 >= len(data) or jumps > 32:
                    return None, len(data)
                after, jumps = after or at + 2, jumps + 1
                at = (size & 0x3F) << 8 | data[at + 1]
            elif size == 0:
                return ".".join(labels) or None, after or at + 1
            elif size < 64 and at + 1 + size <= len(data):
                labels.append(data[at + 1 : at + 1 + size].decode("utf-8", "replace"))
                at += 1 + size
            else:
                break
        return None, len(data)

    counts = [int.from_bytes(data[i : i + 2]) for i in (4, 6)]
    at, first, found = 12, None, []
    for _ in range(min(counts[0], most)):
        asked, at = name(at)
        first, at = first or asked, at + 4
    for _ in range(min(counts[1], most)):
        owner, at = name(at)
        if at + 10 > len(data):
            break
        kind, size = int.from_bytes(data[at : at + 2]), int.from_bytes(data[at + 8 : at + 10])
        value, at = data[at + 10 : at + 10 + size], at + 10 + size
        first = first or owner
        if kind == 1 and len(value) == 4:
            found.append(".".join(map(str, value)))
        elif kind == 28 and len(value) == 16:
            found.append(":".join(f"{int.from_bytes(value[i : i + 2]):x}" for i in range(0, 16, 2)))
    return first, found


def with_names(decoded: DataFrame) -> DataFrame:
    """decode()'s rows with dns_name, compression pointers followed, and dns_answers: the addresses in the answers."""

    @F.pandas_udf("struct<name:string,answers:array<string>>")
    def read(messages: pd.Series) -> pd.DataFrame:
        got = [dns_message(m) if m is not None and len(m) >= 12 else (None, None) for m in messages]
        return pd.DataFrame({"name": [g[0] for g in got], "answers": [g[1] for g in got]})

    message = F.when(F.col("dns_id").isNotNull(), F.substring("bytes", F.col("l7").cast("int") + 1, F.col("payload_len").cast("int")))
    rows = decoded.withColumn("dns_", read(message))
    return rows.withColumns({"dns_name": F.coalesce("dns_.name", "dns_name"), "dns_answers": F.col("dns_.answers")}).drop("dns_")


def byte(at: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col("bytes"), at + 1, F.lit(1))), 16, 10).cast("int")


#: A TCP option as hex digits: a filler, or a kind, a length and a value so long. An option area has 40 bytes at most. `__`
#: stands for a byte that the frame was cut short of.
TCP_SIZED = "(?:" + "|".join(f"{n:02X}" + (f".{{{2 * n - 4}}}" if n > 2 else "") for n in range(2, 41)) + ")"
TCP_OPTION = rf"(?:01|(?!0[01]|__)..{TCP_SIZED})"


def tcp_option(at: Column, end: Column, kind: int, size: int) -> Column:
    """The value of a TCP option of so many bytes; null if it is not there. One search over the area's hex digits instead of
    a step for each byte; the byte behind the area is in it, as that of a last kind's length."""
    area = F.hex(piece(at.cast("int"), (end - at + 1).cast("int")))
    found = F.length(F.regexp_extract(area, rf"^{TCP_OPTION}*?{kind:02X}{size + 2:02X}", 0))
    return number(F.when(found > 0, (at + found / 2).cast("int")), size)


def tcp_option_at(at: Column, end: Column, kind: int) -> Column:
    """Where the value of a TCP option begins (at) and how many bytes it has (size); null if it is not there whole."""
    area = F.rpad(F.hex(piece(at, end - at)), F.greatest(2 * (end - at), F.lit(0)), F.lit("_"))
    found = F.length(F.regexp_extract(area, rf"^{TCP_OPTION}*?{kind:02X}(?={TCP_SIZED})..", 0))
    value = (at + found / 2).cast("int")
    return F.when(found > 0, F.struct(value.alias("at"), (byte(value - 1) - 2).alias("size")))


def with_tcp_options(decoded: DataFrame) -> DataFrame:
    """decode()'s rows with sack (the blocks of a selective acknowledgement, in wire order), ts_value and ts_echo (RFC 2018
    and 7323); null where a segment has no such option."""
    tcp, l4 = F.col("proto") == "tcp", F.col("l4").cast("int")
    rows = decoded.withColumn("end_", F.when(tcp, l4 + F.floor(number(l4 + 12, 1) / 16).cast("int") * 4))
    rows = rows.withColumns({"sack_": tcp_option_at(l4 + 20, F.col("end_"), 5), "times_": tcp_option_at(l4 + 20, F.col("end_"), 8)})
    count = F.floor(F.col("sack_.size") / 8).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(number(F.col("sack_.at") + 8 * i, 4).alias("left"), number(F.col("sack_.at") + 8 * i + 4, 4).alias("right")))
    stamped = F.col("times_.size") == 8
    return rows.withColumns({"sack": F.when(count > 0, blocks), "ts_value": F.when(stamped, number(F.col("times_.at"), 4)), "ts_echo": F.when(stamped, number(F.col("times_.at") + 4, 4))}).drop("sack_", "times_", "end_")


def server_name(hello: Column) -> Column:
    """The name in a ClientHello that starts at `hello` (after the handshake header), from its SNI extension. An extension
    takes four bytes at least, which bounds their number by the length of their list."""
    session = hello + 34
    ciphers = session + 1 + number(session, 1)
    methods = ciphers + 2 + number(ciphers, 2)
    first = methods + 1 + number(methods, 1) + 2
    start = F.struct(first.cast("int").alias("at"), F.lit(None).cast("int").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        kind, size = number(acc["at"], 2), number(acc["at"] + 2, 2)
        return F.struct((acc["at"] + 4 + F.coalesce(size, F.lit(1 << 16))).cast("int").alias("at"), F.when((kind == 0) & acc["found"].isNull(), acc["at"]).otherwise(acc["found"]).alias("found"))

    most = F.greatest(F.floor(F.coalesce(number(first - 2, 2), F.lit(0)) / 4).cast("int"), F.lit(1))
    at = F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["found"])
    return F.nullif(F.decode(F.substring(F.col("bytes"), at + 10, number(at + 7, 2).cast("int")), "UTF-8"), F.lit(""))


def header_checksum_ok(at: Column, words: int = 10) -> Column:
    """Whether the ones'-complement sum of a header of so many 16-bit words comes out right."""
    total = sum((number(at + 2 * i, 2) for i in range(1, words)), number(at, 2))
    folded = F.pmod(total, F.lit(65536)) + F.floor(total / 65536)
    return F.pmod(folded, F.lit(65536)) + F.floor(folded / 65536) == 0xFFFF


def dns_name(at: Column, labels: int = 12) -> Column:
    """The uncompressed name of the first question, up to `labels` labels; null where it does not end in time."""
    start = F.struct(at.cast("int").alias("at"), F.lit("").alias("name"), F.lit(False).alias("done"), F.lit(True).alias("ok"))

    def step(acc: Column, _: Column) -> Column:
        size = F.conv(F.hex(F.substring(F.col("bytes"), acc["at"] + 1, F.lit(1))), 16, 10).cast("int")
        label = F.decode(F.substring(F.col("bytes"), acc["at"] + 2, size), "UTF-8")
        more = ~acc["done"] & (size > 0) & (size < 64)
        joined = F.when(acc["name"] == "", label).otherwise(F.concat(acc["name"], F.lit("."), label))
        return F.struct(
            F.when(more, acc["at"] + 1 + size).otherwise(acc["at"]).alias("at"),
            F.when(more, joined).otherwise(acc["name"]).alias("name"),
            (acc["done"] | F.coalesce(size == 0, F.lit(False))).alias("done"),
            (acc["ok"] & F.coalesce(size < 64, F.lit(False))).alias("ok"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(labels)), start, step, lambda a: F.when(a["done"] & a["ok"] & (a["name"] != ""), a["name"]))


def as_frames(decoded: DataFrame) -> DataFrame:
    """decode()'s rows as the frames that fold_sessions reads; facts it can't see are null."""
    reply = F.coalesce("dns_reply", F.lit(False))
    answers = F.col("dns_answers") if "dns_answers" in decoded.columns else F.lit(None).cast("array<string>")
    return decoded.where("src_ip IS NOT NULL").withColumns({"reply": reply, "dns_answers": answers, "dns_answer": F.get(answers, F.lit(0)), "process": F.lit(None).cast("string"), "rcode": F.col("rcode").cast("int")})
