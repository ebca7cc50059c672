"""RTP, SIP, multicast, streams, fragments and hex dumps on hand-built rows."""

import datetime as dt

import pytest

from packetloom.operators import media, streams
from packetloom.sources.hexdump import read_hexdump

T0 = dt.datetime(2024, 1, 1)


def test_rtp_loss_and_jitter(spark):
    rows = []
    for i, seq in enumerate([10, 11, 13, 14]):
        rows.append((i + 1, int((20 * (seq - 10) + (1 if seq == 14 else 0)) * 1e6), "a", 1, "b", 2, 0, False, seq, 160 * seq, 0x11111111))
    rows.append((9, 5_000_000, "b", 2, "a", 1, 8, False, 65535, 0, 7))
    rows.append((10, 25_000_000, "b", 2, "a", 1, 8, False, 0, 160, 7))
    df = spark.createDataFrame(rows, "ordinal long, ts_ns long, src_ip string, src_port int, dst_ip string, dst_port int, payload_type int, marker boolean, sequence int, timestamp long, ssrc long")
    got = {r.ssrc: r for r in media.rtp_streams(df).collect()}
    one, two = got[0x11111111], got[7]
    assert (one.packets, one.expected, one.lost, one.sequence_errors, one.problem) == (4, 5, 1, 1, True)
    assert one.max_jitter == pytest.approx(1 / 16) and one.max_delta == pytest.approx(40.0)
    assert (two.packets, two.lost, two.problem, two.payload_types) == (2, 0, False, [8])
    assert media.reverse_streams(media.rtp_streams(df)).count() == 2


RTP = "ordinal long, ts_ns long, src_ip string, src_port int, dst_ip string, dst_port int, payload_type int, marker boolean, sequence int, timestamp long, ssrc long, ip_bytes long"


def test_rtp_packets(spark):
    at = [(1, 0), (2, 20), (3, 40), (5, 80), (6, 105), (7, 120)]
    df = spark.createDataFrame([(i, ms * 10**6, "a", 1, "b", 2, 0, n == 1, n, (n - 1) * 160, 9, 200) for i, (n, ms) in enumerate(at)], RTP)
    rows = media.rtp_packets(df).orderBy("ordinal").collect()
    assert [round(r.delta_ms, 3) for r in rows] == [0, 20, 20, 40, 25, 15]
    assert [round(r.jitter_ms, 3) for r in rows] == [0, 0, 0, 0, 0.312, 0.605]
    assert [round(r.skew_ms, 3) for r in rows] == [0, 0, 0, 0, -5, 0]
    assert [round(r.kbps, 1) for r in rows] == [1.6, 3.2, 4.8, 6.4, 8.0, 9.6]
    assert [r.wrong_sequence for r in rows] == [False, False, False, True, False, False]
    one = media.rtp_streams(df).first()
    assert (one.packets, one.expected, one.lost, one.sequence_errors, one.max_delta) == (6, 7, 1, 1, 40.0)


def test_rtp_drift_and_wraps(spark):
    df = spark.createDataFrame([(i, int(i * 20.2e6), "a", 1, "b", 2, 0, False, (65530 + i) % 65536, (2**32 - 800 + i * 160) % 2**32, 9, 200) for i in range(50)], RTP)
    r = media.rtp_drift(media.rtp_packets(df)).first()
    assert round(r.drift_ms) == -10 and round(r.drift_percent, 2) == -0.99
    assert media.rtp_streams(df).first().lost == 0


def test_sip_calls_and_resends(spark):
    m = [
        ("c1", 1, "INVITE", None, "INVITE", 1, "a", "b"), ("c1", 2, "INVITE", None, "INVITE", 1, "a", "b"), ("c1", 3, None, 180, "INVITE", 1, "b", "a"), ("c1", 4, None, 200, "INVITE", 1, "b", "a"),
        ("c1", 5, "ACK", None, "ACK", 1, "a", "b"), ("c1", 6, "BYE", None, "BYE", 2, "a", "b"), ("c1", 7, None, 200, "BYE", 2, "b", "a"),
        ("c2", 8, "INVITE", None, "INVITE", 1, "a", "b"), ("c2", 9, None, 486, "INVITE", 1, "b", "a"), ("c3", 10, "INVITE", None, "INVITE", 1, "a", "b"), ("c3", 11, "CANCEL", None, "CANCEL", 1, "a", "b"), ("c4", 12, "BYE", None, "BYE", 1, "a", "b"),
    ]
    rows = [(c, o, T0 + dt.timedelta(seconds=o), me, s, cm, q, x, y) for c, o, me, s, cm, q, x, y in m]
    df = spark.createDataFrame(rows, "call_id string, ordinal long, ts timestamp_ntz, method string, status int, cseq_method string, cseq long, src string, dst string")
    assert {r.call_id: r.state for r in media.sip_calls(df).collect()} == {"c1": "completed", "c2": "rejected 486", "c3": "cancelled"}
    resent = {r.ordinal: (r.resent, r.setup_ms) for r in media.sip_resent(df).collect()}
    assert resent[2] == (True, None) and resent[1] == (False, None)
    assert resent[5] == (False, 4000)
    items = {r["item"]: r.messages for r in media.sip_statistics(df).collect()}
    assert (items["messages"], items["resent"], items["methods/INVITE"], items["codes/200"], items["setup"]) == (12, 1, 4, 2, 1)


def test_multicast_bursts_and_buffer(spark):
    rows = [("a", "g", i, i * 1_000_000, 1000) for i in range(1, 6)] + [("a", "g", 9, 2 * 10**9, 1000)]
    df = spark.createDataFrame(rows, "src string, dst string, ordinal long, rel_ns long, udp_len int")
    r = media.multicast_streams(df, interval_ms=2, burst_alarm=2, buffer_alarm=2_000, kbits=8).first()
    assert (r.packets, r.max_burst, r.burst_alarms) == (6, 2, 1)
    assert r.max_buffer == 1000 + 5 * 1000 - 5 and r.buffer_alarms == 1


def test_multicast_figures(spark):
    """Three groups: one with bursts and a filling buffer, one slow, one of three datagrams."""
    a = [500_000 + i * 4_000 for i in range(100)] + [1_000_000 + i * 200 for i in range(60)] + [1_020_000 + i * 4_000 for i in range(50)]
    rows = [(t, "10.0.0.5", "239.1.1.1", 1324) for t in a] + [(250_000 + i * 1_000_000, "fe80::1", "ff05::1:3", 48) for i in range(5)] + [(2_000_000 + i * 1_000, "10.0.0.6", "239.1.1.1", 108) for i in range(3)]
    df = spark.createDataFrame([(s, d, i, t * 1000, n) for i, (t, s, d, n) in enumerate(sorted(rows))], "src string, dst string, ordinal long, rel_ns long, udp_len int")
    got = {r.src: (r.packets, round(r.packets_per_s, 6), round(r.avg_bps, 6), round(r.max_bps, 6), r.max_burst, r.burst_alarms, r.max_buffer, r.buffer_alarms) for r in media.multicast_streams(df).collect()}
    assert got["fe80::1"] == (5, 1.25, 480.0, 0.0, 1, 0, 48, 0)
    assert got["10.0.0.6"] == (3, 1500.0, 1296000.0, 17280.0, 2, 0, 108, 0)
    assert got["10.0.0.5"] == (210, 293.296089, 3106592.178771, 8473600.0, 80, 1, 70741, 1)


def test_follow_keeps_first_bytes_and_marks_gaps(spark):
    rows = [("t", 0, 1, 0, 2, None), ("t", 0, 2, 1, 16, b"abc"), ("t", 0, 4, 7, 16, b"gh"), ("t", 0, 5, 3, 16, b"XdeF"), ("t", 1, 6, 50, 16, b"ok"), ("t", 0, 7, 20, 16, b"end")]
    df = spark.createDataFrame(rows, "tuple_id string, way int, ordinal long, seq long, flags int, payload binary")
    out = streams.follow(df)
    one = sorted((r.run, r.ordinal, bytes(r.data)) for r in out.where("way = 0").collect())
    assert one == [(0, 2, b"abc"), (0, 4, b"gh"), (0, 5, b"deF"), (1, 7, b"end")]
    assert [(r.way, bytes(r.data)) for r in streams.turns(out).orderBy("ordinal").collect()] == [(0, b"abcghdeF"), (1, b"ok"), (0, b"end")]


def test_fragments(spark):
    base = (4, "a", "b", 1, 17)
    rows = [(*base, 1, T0, 0, True, b"12345678"), (*base, 2, T0, 16, False, b"z"), (*base, 3, T0, 8, True, b"abcdefgh"), (4, "a", "b", 2, 17, 4, T0, 0, True, b"12345678"), (4, "a", "b", 3, 17, 5, T0, 0, True, b"x" * 8), (4, "a", "b", 3, 17, 6, T0 + dt.timedelta(seconds=31), 8, False, b"y")]
    df = spark.createDataFrame(rows, "version int, src_ip string, dst_ip string, ip_id long, ip_proto int, ordinal long, ts timestamp_ntz, frag_offset long, more boolean, payload binary")
    got = streams.reassemble_fragments(df).collect()
    assert [(r.ip_id, bytes(r.data)) for r in got] == [(1, b"12345678abcdefghz")]
    over = [(*base, 1, T0, 0, True, b"12345678abcdefgh"), (*base, 2, T0, 8, True, b"abcdefgh"), (*base, 3, T0, 12, False, b"efghXYZ")]
    again = [(4, "a", "b", 5, 17, 4, T0, 0, True, b"12345678"), (4, "a", "b", 5, 17, 5, T0, 4, False, b"5679")]
    got = streams.reassemble_fragments(spark.createDataFrame(over + again, df.schema)).collect()
    assert [(r.ip_id, bytes(r.data)) for r in got] == [(1, b"12345678abcdefghXYZ")]


def test_round_trips_skip_resent_ranges(spark):
    rows = [("t", 0, 1, 0, 100, None, 16, 10), ("t", 1, 2, 50, 1, 110, 16, 0), ("t", 0, 3, 60, 110, 1, 16, 10), ("t", 0, 4, 90, 110, 1, 16, 10), ("t", 1, 5, 120, 1, 120, 16, 0)]
    df = spark.createDataFrame(rows, "tuple_id string, way int, ordinal long, ts_us long, seq long, ack long, flags int, payload_len long")
    assert [(r.sent_ordinal, r.rtt_us) for r in streams.round_trips(df).collect()] == [(1, 50)]
    assert streams.throughput(df).count() > 0


def test_hexdump(spark, tmp_path):
    (tmp_path / "d.txt").write_text("0000  00 01 02 03\n0004  04 05\nnote\n0000  ff\n")
    assert [bytes(r.bytes) for r in read_hexdump(spark, str(tmp_path)).orderBy("ordinal").collect()] == [b"\0\1\2\3\4\5", b"\xff"]


def test_request_chain(spark):
    df = spark.createDataFrame([(1, "u", "r", None), (2, "u", "r", None), (3, "u", None, "v")], "ordinal long, uri string, referer string, location string")
    assert {(r["from"], r["to"]): r.hits for r in streams.request_chain(df).collect()} == {("r", "u"): 2, ("u", "v"): 1}
