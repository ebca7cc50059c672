"""Link layers, extension headers, tunnels, quoted flows and application facts on packets made here."""

import ipaddress
import struct

import pytest
from pyspark.sql import functions as F
from test_capture import dns, ethernet, ip4, ipv4, tcp, udp

from packetloom.operators import findings, media, pairing
from packetloom.operators import sessions as S
from packetloom.plans.tables import settle
from packetloom.sources import decode as D

A, B, X, Y = "198.51.100.1", "203.0.113.2", "192.0.2.3", "192.0.2.4"


def ipv6(next_header, body, src="2001:db8::1", dst="2001:db8::2"):
    return struct.pack(">IHBB", 0x60000000, len(body), next_header, 64) + ipaddress.IPv6Address(src).packed + ipaddress.IPv6Address(dst).packed + body


def frames(spark, packets, link=1):
    rows = [(i + 1, None, link, bytearray(p), len(p)) for i, p in enumerate(packets)]
    return spark.createDataFrame(rows, "ordinal long, ts timestamp_ntz, link_type int, bytes binary, orig_len long")


LINKS = [(1, b"\x02" * 12 + b"\x08\0"), (101, b""), (0, b"\x02\0\0\0"), (108, b"\0\0\0\x02"), (113, b"\0" * 14 + b"\x08\0"), (276, b"\x08\0" + b"\0" * 18)]
CHAIN = bytes([44, 0]) + b"\0" * 6 + bytes([60, 0]) + struct.pack(">HI", 0, 77) + bytes([6, 1]) + b"\0" * 14
EXTENDED = [ethernet(0x86DD, ipv6(0, CHAIN + tcp(1000, 443, 9, 0, 2))), ethernet(0x86DD, ipv6(44, bytes([17, 0]) + struct.pack(">HI", 1480 | 1, 77) + b"x" * 16))]
ASKED = ipv4(A, B, 17, udp(5000, 53, dns(1, "one.example", False)))
ICMP = [ethernet(0x0800, ipv4(X, A, 1, b"\x03\x03\0\0\0\0\0\0" + ASKED[:28])), ethernet(0x0800, ipv4(A, B, 1, b"\x08\0\0\0\0\x01\0\x01")), ethernet(0x0800, ASKED)]


def record(kind, body):
    return struct.pack(">BHH", kind, 0x0303, len(body)) + body


def hello(kind, version, random=b"\0" * 32, extensions=b""):
    body = struct.pack(">H", version) + random + b"\0" + (b"\0\x02\x13\x01\x01\0" if kind == 1 else b"\x13\x01\0") + struct.pack(">H", len(extensions)) + extensions
    return record(22, bytes([kind]) + len(body).to_bytes(3) + body)


def tls(body, back=False):
    return ethernet(0x0800, ipv4(*((B, A) if back else (A, B)), 6, tcp(*((443, 999) if back else (999, 443)), 1, 1, 24, body)))


def sip(text, back=False):
    return ethernet(0x0800, ipv4(*((B, A) if back else (A, B)), 17, udp(5060, 5060, text.replace("\n", "\r\n").encode())))


def smb(ident, flags, status=0):
    return b"\0\0\0\x40\xfeSMB" + struct.pack("<HHIHHIIQ", 64, 0, status, 5, 1, flags, 0, ident) + b"\0" * 32


RETRY = bytes.fromhex(D.RETRY_RANDOM)
TLS = [tls(hello(1, 0x0303)), tls(hello(2, 0x0303, RETRY), True), tls(hello(2, 0x0303, RETRY), True), tls(hello(2, 0x0301), True), tls(hello(2, 0x0303, b"\0" * 32, b"\0\x2b\0\x02\x03\x04") + record(21, b"\x02\x28"), True)]
COMMON = 'Call-ID: c1@example\nFrom: "Al" <sip:al@example.test>;tag=1\nTo: <sip:bo@example.test>\n'
SIP = [sip(f"INVITE sip:bo@example.test SIP/2.0\n{COMMON}CSeq: 1 INVITE\n\n"), sip(f"SIP/2.0 180 Ringing\n{COMMON}CSeq: 1 INVITE\n\n", True), sip(f"SIP/2.0 200 OK\n{COMMON}CSeq: 1 INVITE\n\n", True), sip(f"BYE sip:bo@example.test SIP/2.0\n{COMMON}CSeq: 2 BYE\n\n"), sip(f"SIP/2.0 200 OK\n{COMMON}CSeq: 2 BYE\n\n", True)]
SMB = [ethernet(0x0800, ipv4(A, B, 6, tcp(999, 445, 1, 1, 24, smb(7, 0)))), ethernet(0x0800, ipv4(B, A, 6, tcp(445, 999, 1, 1, 24, smb(7, 1, 0x103)))), ethernet(0x0800, ipv4(B, A, 6, tcp(445, 999, 1, 1, 24, smb(7, 1))))]
QUESTION = b"\x03one\x07example\0\0\1\0\1"
ANSWERS = b"\xc0\x0c\0\5\0\1\0\0\0\x3c\0\x06\x03two\xc0\x10" + b"\xc0\x29\0\1\0\1\0\0\0\x3c\0\4" + ip4(X) + b"\xc0\x29\0\x1c\0\1\0\0\0\x3c\0\x10" + ipaddress.IPv6Address("2001:db8::9").packed
GOOD = struct.pack(">HHHHHH", 7, 0x8180, 1, 3, 0, 0) + QUESTION + ANSWERS
DNS = [GOOD, struct.pack(">HHHHHH", 8, 0x8180, 1, 0, 0, 0) + b"\xc0\x0c\0\1\0\1", GOOD[:50]]
LOCAL = struct.pack(">HHHHHH", 0, 0x8400, 0, 1, 0, 0) + b"\x04host\x05local\0\0\1\0\1\0\0\0\x3c\0\4" + ip4(Y)
DNS_FRAMES = [*(ethernet(0x0800, ipv4(B, A, 17, udp(53, 5000, m))) for m in DNS), ethernet(0x0800, ipv4(Y, "224.0.0.251", 17, udp(5353, 5353, LOCAL)))]
PARTS = {"links": [(link, head + ipv4(A, B, 6, tcp(1000, 80, 5, 0, 2))) for link, head in LINKS]} | {name: [(1, p) for p in x] for name, x in (("extended", EXTENDED), ("icmp", ICMP), ("tls", TLS), ("sip", SIP), ("smb", SMB), ("dns", DNS_FRAMES))}


@pytest.fixture(scope="module")
def decoded(spark):
    """All packets above, decoded once; part names them, ordinals count from 1 in each part."""
    rows = [(name, i + 1, None, link, bytearray(p), len(p)) for name, x in PARTS.items() for i, (link, p) in enumerate(x)]
    df = spark.createDataFrame(rows, "part string, ordinal long, ts timestamp_ntz, link_type int, bytes binary, orig_len long").coalesce(1)
    return settle(D.with_names(D.decode(df)), "decoded")


def part(decoded, name):
    return decoded.where(F.col("part") == name)


def test_link_layers(decoded):
    rows = part(decoded, "links").collect()
    assert len(rows) == 6 and {(r.src_ip, r.dst_port, r.seq, r.flags) for r in rows} == {(A, 80, 5, 2)}


def test_ipv6_extension_headers(decoded):
    one, two = part(decoded, "extended").orderBy("ordinal").collect()
    assert (one.proto, one.dst_port, one.seq, one.ip_id, one.frag_offset, one.more_fragments) == ("tcp", 443, 9, 77, 0, False)
    assert (two.proto, two.ip_id, two.frag_offset, two.more_fragments) == ("udp", 77, 1480, True)


def test_tunnels(spark):
    inner = ipv4(X, Y, 6, tcp(1, 80, 5, 0, 2))
    gre = ethernet(0x0800, ipv4(A, B, 47, struct.pack(">HHI", 0x2000, 0x0800, 9) + inner))
    vxlan = ethernet(0x0800, ipv4(A, B, 17, udp(5555, 4789, b"\x08\0\0\0\0\0\x07\0" + ethernet(0x0800, inner))))
    twice = ethernet(0x0800, ipv4(A, B, 4, ipv4("198.51.100.7", "198.51.100.8", 41, ipv6(6, tcp(7, 443, 1, 0, 2)))))
    plain = ethernet(0x0800, inner)
    rows = D.through_tunnels(frames(spark, [gre, vxlan, twice, plain])).orderBy("ordinal").collect()
    assert [(r.src_ip, r.dst_port) for r in rows] == [(X, 80), (X, 80), ("2001:db8:0:0:0:0:0:1", 443), (X, 80)]
    assert [[(o.src, o.dst) for o in r.outer_ips] for r in rows] == [[(A, B)], [(A, B)], [(A, B), ("198.51.100.7", "198.51.100.8")], []]


def test_icmp_quotes(decoded):
    errors = settle(D.icmp_errors(part(decoded, "icmp")), "errors")
    rows = {r.ordinal: r for r in errors.collect()}
    flow = f"udp|{A}|5000|{B}|53"
    assert rows[1].quoted_session == flow and rows[2].quoted_session is None and set(rows) == {1, 2}
    found = {(r.session_id, r.kind) for r in findings.icmp_findings(errors).collect()}
    assert (flow, "icmpReportedUnreachable") in found and len(found) == 2


def test_tls_records_and_findings(decoded):
    records = settle(D.tls_records(part(decoded, "tls")), "records")
    rows = records.orderBy("ordinal").collect()
    assert [(r.ordinal, r.record, r.version) for r in rows if r.record != "alert"] == [(1, "clientHello", None), (2, "helloRetry", 0x0303), (3, "helloRetry", 0x0303), (4, "serverHello", 0x0301), (5, "serverHello", 0x0304)]
    assert [(r.level, r.code) for r in rows if r.record == "alert"] == [(2, 40)]
    assert {r.kind for r in findings.tls_findings(records).collect()} == {"tlsFatalAlert", "tlsDeprecatedVersion", "tlsRepeatedRetryRequest"}


def test_sip_and_smb2(decoded):
    messages = settle(D.sip_messages(part(decoded, "sip")), "sip")
    first = messages.orderBy("ordinal").first()
    assert (first.call_id, first.method, first.cseq, first.cseq_method, first.from_uri, first.to_uri) == ("c1@example", "INVITE", 1, "INVITE", "sip:al@example.test", "sip:bo@example.test")
    assert [r.state for r in media.sip_calls(messages).collect()] == ["completed"]
    headers = settle(D.smb2_messages(part(decoded, "smb")), "smb")
    rows = headers.orderBy("ordinal").collect()
    assert [(r.command, r.message_id, r.reply, r.interim) for r in rows] == [(5, 7, False, False), (5, 7, True, True), (5, 7, True, False)]
    assert [(r.ordinal, r.request_ordinal) for r in pairing.pair_once(headers.where("NOT interim"), ["message_id"], ~F.col("reply")).collect()] == [(3, 1)]


def test_dns_names_and_answers(decoded):
    names = part(decoded, "dns")
    rows = names.orderBy("ordinal").collect()
    assert [(r.dns_name, r.dns_answers) for r in rows] == [("one.example", [X, "2001:db8:0:0:0:0:0:9"]), (None, []), ("one.example", []), ("host.local", [Y])]
    assert [r.app for r in rows] == ["dns", "dns", "dns", "mdns"]
    learned = {r.address: r.name for r in S.learned_names(D.as_frames(names)).collect()}
    assert learned == {X: "one.example", "2001:db8:0:0:0:0:0:9": "one.example", Y: "host.local"}
    session = next(r for r in S.fold_sessions(D.as_frames(names)).collect() if r.server_ip == B)
    assert sorted(session.dns_answers) == ["192.0.2.3", "2001:db8:0:0:0:0:0:9"]


def option(area: bytes, end: int, kind: int, whole: bool):
    """(place, size) of the first option of a kind in a segment's bytes behind its fixed header; end is where the area ends."""
    at = 0
    while at < min(end, len(area)):
        n = area[at + 1] if at + 1 < len(area) else None
        if area[at] == 1:
            at += 1
        elif area[at] == 0 or n is None or n < 2 or (whole and at + n > end):
            return None
        elif area[at] == kind:
            return at + 2, n - 2
        else:
            at += n
    return None


def test_options_against_a_walk_over_their_bytes(spark):
    import random
    import struct

    r = random.Random(11)
    made = [lambda: b"\1", lambda: b"\0", lambda: bytes([3, 3, r.randrange(16)]), lambda: b"\2\4" + r.randbytes(2), lambda: (lambda n: bytes([5, 2 + 8 * n]) + r.randbytes(8 * n))(r.randrange(4)), lambda: b"\x08\x0a" + r.randbytes(8), lambda: bytes([r.choice([2, 3, 5, 8, 30]), r.randrange(14)]), lambda: r.randbytes(r.randrange(1, 6))]
    packets, want = [], {}
    for i in range(600):
        area = b"".join(r.choice(made)() for _ in range(r.randrange(7)))[:40]
        words = 5 + (len(area) + 3) // 4 if r.random() < 0.8 else r.randrange(16)
        area += bytes(-len(area) % 4) if r.random() < 0.7 else r.randbytes(r.randrange(4))
        area = area[: r.randrange(len(area) + 1)] if r.random() < 0.2 else area  # cut short
        packets.append(ethernet(0x0800, ipv4("10.0.0.1", "10.0.0.2", 6, struct.pack(">HHIIBBHHH", 1, 2, 3, 4, words << 4, 16, 9, 0, 0) + area)))
        end = words * 4 - 20
        value = lambda at, n: int.from_bytes(area[at : at + n]) if at + n <= len(area) else None  # noqa: B023, E731
        sack, times = option(area, end, 5, True), option(area, end, 8, True)
        blocks = [(value(sack[0] + 8 * j, 4), value(sack[0] + 8 * j + 4, 4)) for j in range(sack[1] // 8)] if sack else []
        stamped = times is not None and times[1] == 8
        want[i + 1] = (blocks or None, value(times[0], 4) if stamped else None, value(times[0] + 4, 4) if stamped else None)
    got = D.with_tcp_options(D.decode(frames(spark, packets))).select("ordinal", "sack", "ts_value", "ts_echo").collect()
    assert {x.ordinal: (x.sack and [(b.left, b.right) for b in x.sack], x.ts_value, x.ts_echo) for x in got} == want


def test_options_take_no_step_for_each_byte(spark, capsys):
    read = D.with_tcp_options(D.decode(frames(spark, [ethernet(0x0800, ipv4("10.0.0.1", "10.0.0.2", 6, b"\0" * 20))])))
    read.select("mss", "win_shift", "ts_value", "sack").explain()
    plan = capsys.readouterr().out
    assert plan.count("aggregate(") == 1  # the walk over IPv6 headers
