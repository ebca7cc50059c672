"""Frames decoded with the help of frames before them, and streams in linear time."""

import random
import time

import pytest
from test_capture import dns, ethernet, tcp, udp
from test_decode import A, B, frames, hello, record

from packetloom.operators import sessions as S
from packetloom.operators import streams
from packetloom.sources import decode as D
from packetloom.sources import rebuild as R

SNI = b"\0\0" + b"\0\x10" + b"\0\x0e\0\0\x0b" + b"one.example"


def fragment(body, ident, at, more, proto=17):
    import ipaddress
    import struct

    head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), ident, more << 13 | at // 8, 64, proto, 0)
    return ethernet(0x0800, head + ipaddress.IPv4Address(A).packed + ipaddress.IPv4Address(B).packed + body)


def test_fragmented_datagrams_reach_sessions(spark):
    asked = udp(5000, 53, dns(7, "a-long-name-in-pieces.example", False))
    lost = udp(5001, 53, dns(8, "lost.example", False))
    df = frames(spark, [fragment(asked[24:], 1, 24, 0), fragment(lost[:16], 2, 0, 1), fragment(asked[:16], 1, 0, 1), ethernet(0x0806, b"\0" * 28), fragment(asked[16:24], 1, 16, 1)])
    rows = {r.ordinal: r for r in R.sequential(df).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    assert (rows[5].dns_name, rows[5].src_port, rows[5].rebuilt_from, rows[5].src_ip) == ("a-long-name-in-pieces.example", 5000, [3, 5, 1], A)
    assert all(rows[i].rebuilt_from is None for i in (1, 2, 3, 4)) and rows[5].src_mac == rows[3].src_mac
    folded = {(r.client_port, r.dns_query) for r in S.fold_sessions(D.as_frames(R.sequential(df))).collect()}
    assert (5000, "a-long-name-in-pieces.example") in folded


def segments(spark, *parts):
    """TCP frames from (source port, sequence number, payload)."""
    out = []
    for port, seq, payload in parts:
        body = tcp(port, 443, seq, 1, 16, payload)
        import ipaddress
        import struct

        head = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 1, 0, 64, 6, 0)
        out.append(ethernet(0x0800, head + ipaddress.IPv4Address(A).packed + ipaddress.IPv4Address(B).packed + body))
    return frames(spark, out)


HELLO = hello(1, 0x0303, extensions=SNI)
REQUEST = b"GET /x HTTP/1.1\r\nCookie: " + b"c" * 900 + b"\r\nHost: www.example\r\n\r\n"


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        ([(1, 10, HELLO[:30]), (1, 40, HELLO[30:])], {2: "one.example"}),
        ([(1, 10, HELLO[:3]), (1, 13, HELLO[3:40]), (1, 50, HELLO[40:])], {3: "one.example"}),
        ([(1, 10, HELLO[:30]), (1, 60, HELLO[50:]), (1, 10, HELLO[:30]), (1, 40, HELLO[30:50])], {4: "one.example"}),  # out of order, and resent
        ([(1, 2**32 - 5, HELLO[:30]), (1, 25, HELLO[30:])], {2: "one.example"}),  # sequence numbers wrap
        ([(1, 10, HELLO), (1, 10 + len(HELLO), HELLO[:30]), (1, 40 + len(HELLO), HELLO[30:])], {1: "one.example"}),  # the first record was whole
        ([(1, 10, HELLO[:30]), (2, 10, HELLO[30:])], {}),  # another direction
        ([(1, 10, b"opaque"), (1, 16, HELLO[:30]), (1, 46, HELLO[30:])], {3: "one.example"}),  # begins in the middle of a stream
        ([(1, 10, HELLO[:30]), (1, 50, HELLO[40:])], {}),  # a gap stays
        ([(1, 10, HELLO[:30]), (1, 40, HELLO[30:61] + b"x"), (1, 71, HELLO[61:])], {3: "xne.example"}),  # first-observed bytes win
    ],
)
def test_first_record_over_segments(spark, parts, want):
    rows = R.with_first_records(D.decode(segments(spark, *parts))).collect()
    assert {r.ordinal: r.sni for r in rows if r.sni} == want
    assert len(rows) == len(parts)


def test_http_head_over_segments_and_bounds(spark):
    rows = {r.ordinal: r for r in R.with_first_records(D.decode(segments(spark, (1, 10, REQUEST[:2]), (1, 12, REQUEST[2:700]), (1, 710, REQUEST[700:])))).collect()}
    assert (rows[3].http_method, rows[3].http_host, rows[3].app) == ("GET", "www.example", "http")
    big = record(22, b"\1" + b"x" * 16_000)
    cut = [(1, 10 + i, (big + b"y" * 9000)[i : i + 1400]) for i in range(0, len(big) + 9000, 1400)]
    assert not any(r.sni for r in R.with_first_records(D.decode(segments(spark, *cut))).collect())
    walker = R.FirstRecord()
    for i in range(40):  # more pieces than are kept
        walker.add({"seq": 100 + 40 * i if i else 0, "anchor_seq": 0, "ordinal": i, "payload": b"\x16\x03\x03\x20\0"})
    assert walker.data is None and walker.finish() == []


def test_whole_heads_of_one_frame(spark):
    late = b"GET /" + b"p" * 600 + b" HTTP/1.1\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"v" * 40) for i in range(30)) + b"host : late.example\r\n\r\n"
    hidden = b"GET / HTTP/1.1\r\nX: 1\r\n\r\nHost: body.example\r\n"
    beyond = b"GET / HTTP/1.1\r\n" + b"X: 1\r\n" * 32 + b"Host: beyond.example\r\n\r\n"
    many = hello(1, 0x0303, extensions=b"".join(bytes([9, i, 0, 0]) for i in range(200)) + SNI)
    sends = [late, hidden, beyond, b"GET /" + b"p" * 900, many]
    rows = D.decode(segments(spark, *[(i + 1, 1, p) for i, p in enumerate(sends)])).orderBy("ordinal").collect()
    assert [(r.http_method, r.http_host, r.sni) for r in rows] == [("GET", "late.example", None), ("GET", None, None), ("GET", None, None), ("GET", None, None), (None, None, "one.example")]


def test_streams_take_linear_time():
    def seconds(n, make):
        began = time.perf_counter()
        make(n)
        return time.perf_counter() - began

    def follow_gap(n):
        r = streams.Reassembler(most_runs=1 << 30)
        r.add({"seq": 0, "flags": 0, "payload": b"x", "ordinal": 0})
        for i in range(n):
            assert r.add({"seq": 10 + 10 * i, "flags": 0, "payload": b"y" * 10, "ordinal": i + 1}) == []
        assert len(r.add({"seq": 1, "flags": 0, "payload": b"z" * 9, "ordinal": n + 1})) == n + 1

    def unacknowledged(n):
        r = streams.RoundTrips()
        for i in range(n):
            r.add({"way": 0, "seq": 10 * i, "payload_len": 10, "flags": 16, "ack": 1, "ts_us": i, "ordinal": i})
            r.add({"way": 1, "seq": 1, "payload_len": 0, "flags": 16, "ack": 0, "ts_us": i, "ordinal": i})

    for make in (follow_gap, unacknowledged):
        seconds(500, make)
        assert seconds(16_000, make) < 16 * max(seconds(2_000, make), 0.005)


def test_following_is_bounded():
    r = streams.Reassembler(most_bytes=100, most_runs=5)
    r.add({"seq": 0, "flags": 0, "payload": b"x", "ordinal": 0})
    out = [p for i in range(20) for p in r.add({"seq": 10 + 10 * i, "flags": 0, "payload": b"y", "ordinal": i})] + r.finish()
    assert [p[0] for p in out] == list(range(1, 21)) and r.held == 0


def test_round_trips_against_a_plain_list():
    def plain(rows):
        out, sent, edge = [], [[], []], [None, None]
        for way, seq, n, ack, ts, ordinal in rows:
            if n:
                if edge[way] is not None and seq < edge[way]:
                    sent[way] = [s for s in sent[way] if s[0] <= seq]
                else:
                    sent[way].append((seq + n, ts, ordinal))
                edge[way] = max(edge[way] or 0, seq + n)
            done = [s for s in sent[1 - way] if s[0] <= ack]
            if done:
                out.append((way, ordinal, done[-1][2], ts - done[-1][1]))
                sent[1 - way] = [s for s in sent[1 - way] if s[0] > ack]
        return out

    for seed in range(200):
        r = random.Random(seed)
        base = r.choice([0, 2**32 - 20])
        rows = [(r.randint(0, 1), base + r.randint(0, 30), r.choice([0, 0, 1, 5]), base + r.randint(0, 40), i * 10, i) for i in range(40)]
        walker = streams.RoundTrips()
        got = [x for way, seq, n, ack, ts, o in rows for x in walker.add({"way": way, "seq": seq % 2**32, "payload_len": n, "flags": 16, "ack": ack % 2**32, "ts_us": ts, "ordinal": o})]
        assert got == plain(rows)
