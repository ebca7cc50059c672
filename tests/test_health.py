"""TCP health: credited bytes against a set of bytes, edges, windows, selective acknowledgements and their duplicates."""

import random

import pytest
from test_capture import ethernet, ip4, ipv4
from test_decode import frames

from packetloom.operators import health as H
from packetloom.sources import decode as D

SYN, ACK = 2, 16
SCHEMA = "tuple_id string, way int, ordinal long, ts_us long, seq long, ack long, flags int, payload_len long, win long, shift int, sack array<struct<left:long,right:long>>"


def rows(spark, *segments):
    """(way, seq, ack, flags, payload_len, win, shift, sack blocks); one microsecond apart."""
    return spark.createDataFrame([("t", s[0], i + 1, i, *s[1:7], [{"left": a, "right": b} for a, b in s[7]] if len(s) > 7 else None) for i, s in enumerate(segments)], SCHEMA)


@pytest.mark.parametrize("seed", range(150))
def test_coverage_against_a_set_of_bytes(seed):
    r = random.Random(seed)
    c, known, edge = H.Coverage(), set(), 0
    for i in range(40):
        if r.random() < 0.4:
            low, high = edge, edge + r.randint(1, 12)
            edge, cumulative = high, True
        else:
            low = edge + r.randint(0, 30)
            high, cumulative = low + r.randint(1, 15), False
        fresh = set(range(low, high)) - known
        known |= fresh
        got = c.add({"low": low, "high": high, "cumulative": cumulative, "ordinal": i, "ts_us": i})
        assert got == ([(i, i, len(fresh))] if fresh else [])
        assert c.lows == sorted(c.lows) and all(h < low2 for h, low2 in zip(c.highs, c.lows[1:], strict=False))


def test_edges_flight_and_windows(spark):
    base = 2**32 - 2
    df = rows(
        spark, (0, base, None, SYN, 0, 100, 2), (1, 5, base + 1, SYN | ACK, 0, 200, 30), (0, base + 1, 6, ACK, 0, 10, None), (0, base + 1, 6, ACK, 10, 10, None), (0, 9, 6, ACK, 10, 10, None),
        (1, 6, 9, ACK, 0, 3, None), (0, 19, 6, ACK, 10, 10, None), (1, 6, 9, ACK, 0, 3, None, [(19, 29)]), (1, 6, 29, ACK, 0, 3, None),
    )
    placed = {r.ordinal: r for r in H.positions(df).collect()}
    assert (placed[4].start, placed[4].end, placed[5].start, placed[5].end) == (1, 11, 11, 21)
    assert placed[1].own_in_flight is None and placed[2].peer_in_flight == 0
    assert [placed[i].own_in_flight for i in (4, 5, 7)] == [10, 20, 20] and placed[6].peer_in_flight == 10 and placed[9].peer_in_flight == 0
    assert {r.scaling for r in placed.values()} == {"scaled"}
    assert (placed[1].offered, placed[3].offered, placed[6].offered) == (100, 40, 3 << 14)
    assert [(r.ordinal, r.low, r.high, r.duplicate) for r in H.sack_ranges(H.positions(df)).collect()] == [(8, 21, 31, False)]
    assert {(r.way, r.ordinal): r.bytes for r in H.credits(H.positions(df)).collect()} == {(0, 6): 10, (0, 8): 10, (0, 9): 10}
    rates = H.goodput(H.positions(df), 4).where("way = 0").orderBy("part").collect()
    assert [(r.part, round(r.bytes_per_s)) for r in rates] == [(2, 5_000_000), (3, 10_000_000)]


def test_duplicates_are_not_credited(spark):
    # A first block below the acknowledgement, one inside the second block, and one that is neither.
    df = rows(spark, (0, 0, None, SYN, 0, 9, None), (1, 0, 1, ACK, 0, 9, None), (1, 0, 11, ACK, 0, 9, None, [(1, 5)]), (1, 0, 11, ACK, 0, 9, None, [(21, 25), (16, 31)]), (1, 0, 11, ACK, 0, 9, None, [(41, 51), (16, 31)]))
    placed = H.positions(df)
    assert sorted((r.ordinal, r.block, r.duplicate) for r in H.sack_ranges(placed).collect()) == [(3, 0, True), (4, 0, True), (4, 1, False), (5, 0, False), (5, 1, False)]
    assert {r.ordinal: r.bytes for r in H.credits(placed).collect()} == {3: 10, 4: 15, 5: 10}
    assert {r.scaling for r in placed.collect()} == {"unknown"}
    one = rows(spark, (0, 0, None, SYN, 0, 9, 3), (1, 0, 1, SYN | ACK, 0, 9, None), (0, 1, 1, ACK, 0, 9, None))
    assert {r.scaling: r.offered for r in H.positions(one).collect()} == {"raw": 9}


def test_untimed_segments_and_the_half_circle(spark):
    df = rows(spark, (0, 100, None, SYN, 0, 9, None), (0, 100 + 2**31, 0, ACK, 5, 9, None), (0, 50, 0, ACK, 5, 9, None)).withColumn("ts_us", __import__("pyspark").sql.functions.expr("IF(ordinal = 1, NULL, ts_us)"))
    got = {r.ordinal: r.start for r in H.positions(df).collect()}
    assert got == {2: None, 3: -50}
    assert H.goodput(H.positions(df.limit(0))).count() == 0


def test_options_of_segments(spark):
    def tcp(options):
        import struct

        words = (20 + len(options)) // 4
        return ethernet(0x0800, ipv4("10.0.0.1", "10.0.0.2", 6, struct.pack(">HHIIBBHHH", 1, 2, 3, 4, words << 4, ACK, 9, 0, 0) + options))

    import struct

    times = b"\1\1\x08\x0a" + struct.pack(">II", 7, 9)
    sack = b"\1\1\5\x12" + struct.pack(">IIII", 1, 2, 2**32 - 1, 4)
    cut = b"\1\1\1\1\1\1\5\x12"
    got = D.with_tcp_options(D.decode(frames(spark, [tcp(times), tcp(times[:12] + sack), tcp(b""), tcp(cut)]))).orderBy("ordinal").collect()
    assert [(r.ts_value, r.ts_echo) for r in got] == [(7, 9), (7, 9), (None, None), (None, None)]
    assert [r.sack and [(b.left, b.right) for b in r.sack] for r in got] == [None, [(1, 2), (2**32 - 1, 4)], None, None]
    assert ip4("10.0.0.1")
