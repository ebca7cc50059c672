"""Sequence, flow-control and lifecycle rules on hand-built segments."""

import pytest

from packetloom.operators import tcp_state as t

SYN, ACK, FIN, RST = 2, 16, 1, 4


@pytest.mark.parametrize(
    ("earlier", "segment", "disposition", "expected"),
    [
        ([], (100, SYN, 0), "initialized", 101),
        ([(100, SYN, 0)], (101, 0, 3), "advanced", 104),
        ([(100, SYN, 0), (101, 0, 3)], (104, FIN, 0), "advanced", 105),
        ([(100, 0, 10)], (100, 0, 10), "duplicate", 110),
        ([(100, 0, 10)], (109, ACK, 1), "keepAlive", 110),
        ([(100, 0, 10)], (108, 0, 1), "duplicate", 110),
        ([(100, 0, 4)], (999, ACK, 0), "noSequenceSpace", 104),
        ([(100, 0, 10)], (105, 0, 10), "overlap", 115),
        ([(100, 0, 10)], (120, 0, 5), "outOfOrderBuffered", 110),
        ([(100, 0, 10), (120, 0, 5)], (110, 0, 10), "pendingDrained", 125),
        ([(2**32 - 5, 0, 10)], (5, 0, 1), "advanced", 6),
        ([(0, 0, 1)], (1 + 2**31, 0, 1), "serialAmbiguous", 1),
    ],
)
def test_sequence_tracker(earlier, segment, disposition, expected):
    tracker = t.SequenceTracker()
    for s in earlier:
        tracker.ingest(*s)
    assert tracker.ingest(*segment) == disposition
    assert tracker.expected == expected


def test_pending_intervals_merge_and_overflow():
    tracker = t.SequenceTracker()
    tracker.ingest(0, 0, 1)
    for i in range(t.MAX_PENDING):
        assert tracker.ingest(10 + 4 * i, 0, 2) == "outOfOrderBuffered"
    assert tracker.ingest(10_000, 0, 2) == "pendingOverflow"
    assert len(tracker.pending) == t.MAX_PENDING
    assert tracker.ingest(12, 0, 2) == "outOfOrderBuffered"
    assert len(tracker.pending) == t.MAX_PENDING - 1


def kinds(segments):
    state, out = t.TupleState(), []
    for way, seq, ack, flags, payload, window in segments:
        c, k = state.ingest(way, seq, ack, flags, payload, window)
        out.append(k)
    return c, out


def test_three_way_handshake_and_orderly_close():
    c, out = kinds([(0, 100, None, SYN, 0, 10), (1, 500, 101, SYN | ACK, 0, 10), (0, 101, 501, ACK, 0, 10), (0, 101, 501, ACK, 5, 10), (1, 501, 106, FIN | ACK, 0, 10), (0, 106, 502, FIN | ACK, 0, 10), (1, 502, 107, ACK, 0, 10)])
    assert out[0] == ["firstObserved", "syn"]
    assert out[1] == ["synAck"]
    assert out[2] == ["handshakeCompleted"]
    assert out[3] == ["payloadObserved"]
    assert out[5] == ["fin"]
    assert out[6] == ["lateSegment"]
    assert (c.phase, c.handshake, c.close) == ("closed", "threeWayObserved", "orderly")


def test_pure_syn_after_close_starts_an_incarnation():
    c, out = kinds([(0, 1, None, SYN, 0, 1), (1, 0, 2, RST | ACK, 0, 0), (0, 900, None, SYN, 0, 1)])
    assert c.number == 1
    assert out[1] == ["rst"]
    assert out[2] == ["firstObserved", "syn"]


def test_other_syn_on_a_live_connection_is_reuse():
    _, out = kinds([(0, 1, None, SYN, 0, 1), (0, 700, None, SYN, 0, 1)])
    assert "ambiguousTupleReuse" in out[1]


def test_duplicate_acks_and_fast_retransmission():
    start = [(0, 0, 1, ACK, 10, 50), (1, 1, 10, ACK, 0, 50)]
    _, out = kinds([*start, (1, 1, 10, ACK, 0, 50), (1, 1, 10, ACK, 0, 50)])
    assert "duplicateAcknowledgement" not in out[2]  # no sequence edge of that side is known yet
    known = [(1, 0, 0, ACK, 1, 50), (0, 0, 1, ACK, 10, 50), (1, 1, 10, ACK, 0, 50), (1, 1, 10, ACK, 0, 50), (1, 1, 10, ACK, 0, 50), (0, 10, 1, ACK, 5, 50)]
    _, out = kinds(known)
    assert out[3] == ["duplicateAcknowledgement"]
    assert "fastRetransmission" in out[5]


def test_zero_window_probe():
    _, out = kinds([(0, 0, 5, ACK, 10, 50), (1, 5, 10, ACK, 0, 0), (0, 10, 5, ACK, 1, 50)])
    assert "zeroWindow" in out[1]
    assert "zeroWindowProbe" in out[2]


def test_window_full_needs_both_syns():
    state = t.TupleState()
    out = []
    for s in [(0, 0, None, SYN, 0, 100, 1), (1, 0, 1, SYN | ACK, 0, 10, 2), (0, 1, 1, ACK, 0, 100, None), (1, 1, 1, ACK, 0, 10, None), (0, 1, 1, ACK, 40, 100, None)]:
        out.append(state.ingest(*s)[1])
    assert "windowFull" in out[4]
    _, plain = kinds([(0, 1, 1, ACK, 5, 100), (1, 1, 6, ACK, 0, 10), (0, 6, 1, ACK, 10, 100)])
    assert "windowFull" not in plain[2]
