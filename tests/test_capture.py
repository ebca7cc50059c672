"""Capture files and byte decoding, on packets made here in documentation address ranges."""

import gzip
import struct

import pytest

from packetloom.operators import sessions as S
from packetloom.sources import capture, decode


def ip4(a):
    return bytes(int(x) for x in a.split("."))


def ethernet(kind, body):
    return b"\x02" * 6 + b"\x04" * 6 + struct.pack(">H", kind) + body


def ipv4(src, dst, proto, body):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 64, proto, 0) + ip4(src) + ip4(dst) + body


def tcp(sport, dport, seq, ack, flags, body=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 0x50, flags, 1000, 0, 0) + body


def udp(sport, dport, body):
    return struct.pack(">HHHH", sport, dport, 8 + len(body), 0) + body


def dns(ident, name, reply):
    q = b"".join(bytes([len(p)]) + p.encode() for p in name.split(".")) + b"\0\0\1\0\1"
    return struct.pack(">HHHHHH", ident, 0x8180 if reply else 0x0100, 1, 0, 0, 0) + q


CORPUS = [
    ethernet(0x0806, struct.pack(">HHBBH", 1, 0x0800, 6, 4, 1) + b"\x02" * 6 + ip4("198.51.100.10") + b"\0" * 6 + ip4("198.51.100.1")),
    ethernet(0x0800, ipv4("198.51.100.10", "203.0.113.5", 1, b"\x08\0" + b"\0" * 6)),
    ethernet(0x0800, ipv4("198.51.100.10", "203.0.113.53", 17, udp(54000, 53, dns(7, "one.example", False)))),
    ethernet(0x0800, ipv4("203.0.113.53", "198.51.100.10", 17, udp(53, 54000, dns(7, "one.example", True)))),
    ethernet(0x0800, ipv4("198.51.100.10", "203.0.113.5", 6, tcp(52344, 443, 999, 0, 2))),
    ethernet(0x0800, ipv4("198.51.100.10", "203.0.113.5", 6, tcp(52344, 443, 1000, 1, 24, b"\x16\x03\x01\x00\x20\x01" + b"\0" * 20))),
    ethernet(0x8100, b"\0\1" + struct.pack(">H", 0x0800) + ipv4("198.51.100.10", "203.0.113.6", 6, tcp(52100, 80, 1, 1, 24, b"GET /health HTTP/1.1\r\nHost: http.example\r\n\r\n"))),
]


def pcap(order, nanos, frames):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1_700_000_000 + i, 5, len(f), len(f)) + f
    return out


def pcapng(order, frames):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        n = len(body) + 12
        return struct.pack(order + "II", kind, n) + body + struct.pack(order + "I", n)

    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHB3xHH", 9, 1, 9, 0, 0))
    for i, f in enumerate(frames):
        t = (1_700_000_000 + i) * 10**9 + 5
        out += block(6, struct.pack(order + "IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    return out + block(3, struct.pack(order + "I", len(frames[0])) + frames[0])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("nanos", [False, True])
def test_pcap_variants(order, nanos):
    got = list(capture.records(pcap(order, nanos, CORPUS)))
    assert [r.data for r in got] == CORPUS
    assert got[1].ts_ns == 1_700_000_001 * 10**9 + (5 if nanos else 5000)
    assert list(capture.records(gzip.compress(pcap(order, nanos, CORPUS)))) == got


@pytest.mark.parametrize("order", "<>")
def test_pcapng(order):
    got = list(capture.records(pcapng(order, CORPUS)))
    assert [r.data for r in got] == [*CORPUS, CORPUS[0]]
    assert got[0].ts_ns == 1_700_000_000 * 10**9 + 5
    assert got[-1].ts_ns is None


def test_damaged_tail_is_reported(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap("<", False, CORPUS)[:-3])
    rows = capture.read_capture(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert len(rows) == len(CORPUS)
    assert rows[-1].problem == "record" and rows[-1].bytes is None
    assert capture.sniff(b"") == "tooShort" and capture.sniff(b"abcd") == "unknown"


def test_decode_and_fold(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap("<", False, CORPUS))
    frames = decode.decode(capture.read_capture(spark, str(tmp_path)))
    rows = frames.orderBy("ordinal").collect()
    assert [r.app for r in rows] == ["arp", "icmp", "dns", "dns", "tcp", "tls", "http"]
    assert rows[2].dns_name == "one.example" and rows[2].dns_id == 7 and rows[3].dns_reply
    assert rows[4].flags == 2 and rows[4].seq == 999 and rows[4].payload_len == 0
    assert rows[5].tls_record == 22 and rows[5].tls_handshake == 1
    assert (rows[6].http_method, rows[6].http_host, rows[6].src_port) == ("GET", "http.example", 52100)
    sessions = {(r.proto, r.server_ip): r for r in S.fold_sessions(decode.as_frames(frames)).collect()}
    assert len(sessions) == 5
    d = sessions["udp", "203.0.113.53"]
    assert (d.bytes_up, d.bytes_down) == (len(CORPUS[2]), len(CORPUS[3]))
    assert sessions["tcp", "203.0.113.5"].packets_up == 2


def test_round_trip_through_writer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcap").write_bytes(pcap("<", False, CORPUS))
    frames = capture.read_capture(spark, str(tmp_path / "in")).selectExpr("*", "0L AS file")
    out = capture.write_captures(frames, str(tmp_path / "out")).collect()
    assert [r.data for r in capture.records(bytes(out[0].content))] == CORPUS
    facts = capture.properties(spark, str(tmp_path / "in")).first()
    assert facts.format == "pcap" and facts.frames == len(CORPUS) and facts.link_types == [1]


def test_options_server_name_and_checksum(spark):
    name = b"secure.example"
    sni = struct.pack(">HHHBH", 0, len(name) + 5, len(name) + 3, 0, len(name)) + name
    other = struct.pack(">HH", 23, 0)
    hello = b"\x03\x03" + b"\0" * 32 + b"\x04abcd" + b"\0\x02\x13\x01" + b"\x01\0" + struct.pack(">H", len(other + sni)) + other + sni
    record = b"\x16\x03\x01" + struct.pack(">H", len(hello) + 4) + b"\x01" + len(hello).to_bytes(3, "big") + hello
    options = b"\x02\x04\x05\xb4\x01\x03\x03\x07"
    syn = struct.pack(">HHIIBBHHH", 1, 443, 5, 0, 0x70, 2, 1000, 0, 0) + options
    head = bytearray(ipv4("192.0.2.1", "192.0.2.2", 6, syn))
    total = sum(struct.unpack(">10H", head[:20]))
    head[10:12] = struct.pack(">H", 0xFFFF - ((total & 0xFFFF) + (total >> 16)))
    rows = [(bytearray(ethernet(0x0800, bytes(head))), 1), (bytearray(ethernet(0x0800, ipv4("192.0.2.1", "192.0.2.2", 6, tcp(1, 443, 6, 1, 24, record)))), 1), (bytearray(ethernet(0x0800, ipv4("192.0.2.1", "192.0.2.2", 6, tcp(22, 9, 6, 1, 24, b"SSH-2.0-x\r\n")))), 1)]
    df = decode.decode(spark.createDataFrame(rows, "bytes binary, link_type int"))
    got = df.select("win_shift", "mss", "sni", "app", decode.header_checksum_ok(df["l3"]).alias("ok")).collect()
    assert (got[0].win_shift, got[0].mss, got[0].ok) == (7, 1460, True)
    assert (got[1].sni, got[1].app, got[1].ok) == ("secure.example", "tls", False)
    assert got[2].app == "ssh"
