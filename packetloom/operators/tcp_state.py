"""Ordered per-connection state: sequence space, acknowledgements and windows, and the connection lifecycle.

These are recurrences over a tuple's segments in capture order. `connection_events` runs them over rows
partitioned by tuple and sorted within partitions; `streaming.live` runs the same classes on stored state.

Sequence numbers are unwrapped on arrival: a direction counts on an unbounded line, and a 32-bit number stands for
the place on that line nearest to the one expected (RFC 9293, serial numbers of RFC 1982). Everything else is
then comparison of plain integers. Acknowledgements and windows are judged against the segments by which either
direction last spoke (RFC 9293, 5681 and 7323); the lifecycle keeps facts and derives phase and handshake from them.
"""

from __future__ import annotations

import json
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.sessions import ACK, FIN, RST, SYN, with_tuple

SPACE = 1 << 32
HALF = 1 << 31
MAX_PENDING = 32
#: Fixed value: the largest window shift (RFC 7323).
MAX_SHIFT = 14


def offset(a: int, b: int) -> int:
    """Signed distance from b to a on the 32-bit circle; the exact half space counts as behind."""
    return (a - b + HALF) % SPACE - HALF


@dataclass(frozen=True)
class Segment:
    way: int
    seq: int
    ack: int | None
    flags: int
    payload: int
    window: int
    shift: int | None = None

    @cached_property
    def size(self) -> int:
        """Sequence numbers that it takes: its payload, SYN and FIN."""
        return self.payload + bool(self.flags & SYN) + bool(self.flags & FIN)

    @property
    def end(self) -> int:
        return (self.seq + self.size) % SPACE

    @property
    def acks(self) -> bool:
        return bool(self.flags & ACK) and self.ack is not None

    @property
    def steady(self) -> bool:
        """An acknowledgement of the connection's middle: no SYN, no FIN."""
        return self.acks and not self.flags & (SYN | FIN)


class SequenceTracker:
    """What of one direction's sequence space has been seen: all up to `head`, and islands beyond it."""

    def __init__(self):
        self.head: int | None = None
        self.pending: list[tuple[int, int]] = []

    @property
    def expected(self) -> int | None:
        return None if self.head is None else self.head % SPACE

    def ingest(self, seq: int, flags: int, payload: int) -> str:
        size = Segment(0, seq, None, flags, payload, 0).size
        if size == 0:
            return "noSequenceSpace"
        if not 0 < size < HALF:
            return "serialAmbiguous"
        if self.head is None:
            self.head = seq + size
            return "initialized"
        low = self.head + offset(seq, self.head)
        high = low + size
        if self.head - low == HALF or high - self.head >= HALF:
            return "serialAmbiguous"
        if low > self.head:
            return self._beyond(low, high)
        if high <= self.head:
            return "keepAlive" if (low, size, payload) == (self.head - 1, 1, 1) else "duplicate"
        reached, partly = self._join(high), low < self.head
        drained, self.head = reached > high, reached
        return "overlap" if partly else "pendingDrained" if drained else "advanced"

    def _join(self, high: int) -> int:
        """Take up all islands that touch the line up to high; where the line then ends."""
        while self.pending and self.pending[0][0] <= high:
            high = max(high, self.pending.pop(0)[1])
        return high

    def _beyond(self, low: int, high: int) -> str:
        touching = [p for p in self.pending if p[0] <= high and low <= p[1]]
        self.pending = [p for p in self.pending if p not in touching]
        insort(self.pending, (min([low, *(a for a, _ in touching)]), max([high, *(b for _, b in touching)])))
        if len(self.pending) <= MAX_PENDING:
            return "outOfOrderBuffered"
        self.pending.pop()  # the furthest one
        return "pendingOverflow"


@dataclass
class Voice:
    """One direction so far: where its data ends, and the segments by which it last said what now holds."""

    #: Number after the last one sent; the byte of a probe counts once it is acknowledged.
    edge: int | None = None
    syn: Segment | None = None
    #: The last segment but resets, and the last one that acknowledged.
    last: Segment | None = None
    confirming: Segment | None = None
    #: What the last segment wants answered: a probe, a keep-alive, or nothing.
    waiting: str | None = None
    #: Repeats of the last acknowledgement, and whether the segment that they ask for was sent again.
    echoes: int = 0
    mended: bool = False

    @property
    def acked(self) -> int | None:
        return self.confirming.ack if self.confirming else None

    @property
    def shut(self) -> bool:
        return self.last is not None and self.last.window == 0

    def permits(self, peer: Voice) -> int | None:
        """The first number that the peer may not send yet. A window is scaled where both SYNs offered it and it does not
        stand in a SYN itself (RFC 7323, 2.2); without both SYNs nobody knows."""
        if self.syn is None or peer.syn is None or self.confirming is None:
            return None
        scaled = not self.last.flags & SYN and self.syn.shift is not None and peer.syn.shift is not None
        return (self.confirming.ack + (self.last.window << (min(self.syn.shift, MAX_SHIFT) if scaled else 0))) % SPACE


class FlowControl:
    """What a segment shows of acknowledgements and windows: first its data is held against what the peer allowed and
    confirmed, then its acknowledgement against what the peer sent and what this side said before."""

    def __init__(self):
        self.voices = (Voice(), Voice())

    def ingest(self, s: Segment, disposition: str) -> list[str]:
        me, peer = self.voices[s.way], self.voices[1 - s.way]
        if s.flags & SYN:
            me.syn = s
        if s.flags & RST:
            return []
        probes = s.steady and s.payload == 1 and peer.shut and me.edge == s.seq  # RFC 9293, 3.8.6.1
        found = ["zeroWindowProbe"] if probes else self._data(s, me, peer, disposition) if s.payload and not s.flags & SYN else []
        if s.steady and s.window == 0:
            found.append("zeroWindow")
        if s.acks:
            found += self._acknowledgement(s, me, peer)
            me.confirming = s
        if s.size and not probes and (me.edge is None or offset(s.end, me.edge) > 0):
            me.edge = s.end
        me.last, me.waiting = s, "probe" if probes else "keepAlive" if disposition == "keepAlive" else None
        return found

    @staticmethod
    def _data(s: Segment, me: Voice, peer: Voice, disposition: str) -> list[str]:
        found = []
        if s.steady and peer.permits(me) == s.end:
            found.append("windowFull")
        if peer.acked is not None:
            if peer.acked == s.seq and peer.echoes >= 2 and not peer.mended:  # RFC 5681, 3.2
                peer.mended = True
                found.append("fastRetransmission")
            if disposition == "duplicate" and offset(s.end, peer.acked) <= 0:
                found.append("spuriousRetransmission")
        return found

    @staticmethod
    def _acknowledgement(s: Segment, me: Voice, peer: Voice) -> list[str]:
        """Also moves the peer's edge over a probe's byte that is taken, and closes its keep-alive."""
        found = []
        step = None if me.confirming is None else (s.ack - me.acked) % SPACE
        alone = s.steady and s.payload == 0 and me.edge == s.seq
        reopens = False
        if alone and peer.waiting == "probe" and me.shut and step in (0, 1):
            takes = (s.ack - peer.last.seq) % SPACE
            reopens = s.window > 0 and takes == step == 1
            answers = s.window == 0 and takes in (0, 1)
            if answers:
                found.append("zeroWindowProbeAcknowledgement")
            if takes == 1 and (answers or reopens):
                peer.edge = s.ack
        if peer.edge is not None and offset(s.ack, peer.edge) > 0:
            found.append("ackedUnseenSegment")
        kept_alive = peer.waiting == "keepAlive" and peer.edge == s.ack
        if kept_alive:
            peer.waiting = None
        if reopens or (alone and step == 0 and s.window not in (0, me.last.window)):
            found.append("windowUpdate")
        if step:
            me.echoes, me.mended = 0, False
        elif step == 0 and alone and not kept_alive and s.window == me.last.window != 0:
            me.echoes += 1
            found.append("duplicateAcknowledgement")
        return found


#: Sequence dispositions that are events of their own.
NOTED = {"duplicate": "retransmission", "overlap": "overlap", "outOfOrderBuffered": "outOfOrderBuffered", "pendingOverflow": "pendingOverflow", "keepAlive": "keepAlive"}


@dataclass
class Connection:
    """One incarnation of a tuple. It keeps what was seen; phase and handshake follow from that."""

    number: int
    frames: int = 0
    opener: int | None = None
    #: Initial sequence numbers of the side that opened and of the one that accepted.
    asked: int | None = None
    accepted: int | None = None
    completed: bool = False
    began_with_syn: bool = False
    carried: bool = False
    fins: set = field(default_factory=set)
    close: str | None = None
    trackers: tuple = field(default_factory=lambda: (SequenceTracker(), SequenceTracker()))
    flow: FlowControl = field(default_factory=FlowControl)

    @property
    def handshake(self) -> str:
        return "threeWayObserved" if self.completed else "synAckObserved" if self.accepted is not None else "synObserved" if self.opener is not None else "none"

    @property
    def phase(self) -> str:
        if not self.frames:
            return "none"
        if self.close:
            return "closed"
        return "closing" if self.fins else "opening" if self.began_with_syn and not (self.completed or self.carried) else "active"

    def ingest(self, s: Segment) -> list[str]:
        disposition = self.trackers[s.way].ingest(s.seq, s.flags, s.payload)
        noted = [NOTED[disposition]] if disposition in NOTED else []
        noted += self.flow.ingest(s, disposition)
        out = [] if self.frames else ["firstObserved"]
        self.frames += 1
        if s.flags & RST:
            self.close = f"reset{s.way}"
            return [*out, "rst", *(["payloadObserved"] if self.frames == 1 and s.payload else []), *noted]
        if s.flags & SYN:
            out.append(self._opening(s))
        elif self.accepted is not None and not self.completed and s.acks and (s.way, s.ack) == (self.opener, (self.accepted + 1) % SPACE):
            self.completed = True
            out.append("handshakeCompleted")
        if s.payload > 0:
            self.carried = True
            out.append("payloadObserved")
        if s.flags & FIN and not s.flags & SYN:
            self.fins.add(s.way)
            self.close = "orderly" if len(self.fins) == 2 else None
            out.append("fin")
        return out + noted

    def _opening(self, s: Segment) -> str:
        """What a SYN means here: the handshake's next step, a repeat of one, or a tuple used by someone else."""
        start, reply = self.frames == 1, bool(s.flags & ACK)
        self.began_with_syn |= start
        if not reply:
            if start:
                self.opener, self.asked = s.way, s.seq
            return "syn" if (self.opener, self.asked) == (s.way, s.seq) else "ambiguousTupleReuse"
        fits = start or (self.opener == 1 - s.way and s.ack == (self.asked + 1) % SPACE and self.accepted in (None, s.seq))
        if fits:
            self.accepted = s.seq
        return "synAck" if fits else "ambiguousTupleReuse"


class TupleState:
    """All incarnations of a tuple, of which only the current one is kept: a pure SYN after a close starts the next."""

    def __init__(self):
        self.current = Connection(0)

    def ingest(self, way: int, seq: int, ack: int | None, flags: int, payload: int, window: int, shift: int | None = None) -> tuple[Connection, list[str]]:
        if self.current.close:
            if flags & (SYN | ACK) != SYN:
                return self.current, ["lateSegment"]  # nothing else reopens a closed connection
            self.current = Connection(self.current.number + 1)
        return self.current, self.current.ingest(Segment(way, seq, ack, flags, payload, window, shift))


def saved(state: TupleState) -> str:
    """A tuple's state as JSON text: plain numbers and names, readable by a later version of these classes."""
    c = state.current
    segment = lambda s: s and [s.way, s.seq, s.ack, s.flags, s.payload, s.window, s.shift]
    return json.dumps(
        {
            "connection": {k: getattr(c, k) for k in _FACTS} | {"fins": sorted(c.fins)},
            "lines": [[t.head, t.pending] for t in c.trackers],
            "voices": [{k: getattr(v, k) for k in ("edge", "waiting", "echoes", "mended")} | {k: segment(getattr(v, k)) for k in ("syn", "last", "confirming")} for v in c.flow.voices],
        }
    )


_FACTS = ("number", "frames", "opener", "asked", "accepted", "completed", "began_with_syn", "carried", "close")


def restored(text: str) -> TupleState:
    held, state = json.loads(text), TupleState()
    facts = held["connection"]
    c = state.current = Connection(**{k: facts[k] for k in _FACTS}, fins=set(facts["fins"]))
    for tracker, (head, pending) in zip(c.trackers, held["lines"], strict=True):
        tracker.head, tracker.pending = head, [tuple(x) for x in pending]
    for voice, said in zip(c.flow.voices, held["voices"], strict=True):
        for k in ("edge", "waiting", "echoes", "mended"):
            setattr(voice, k, said[k])
        for k in ("syn", "last", "confirming"):
            setattr(voice, k, said[k] and Segment(*said[k]))
    return state


EVENT_SCHEMA = "tuple_id string, incarnation int, ordinal long, way int, kind string, payload_len long, phase string, handshake string, close string"


def walk(tuple_id: str, rows, state: TupleState) -> list[tuple]:
    """rows: (ordinal, way, seq, ack, flags, payload, window, shift) in capture order."""
    out = []
    for ordinal, way, seq, ack, flags, payload, window, shift in rows:
        c, kinds = state.ingest(way, seq, ack, flags, payload, window, shift)
        out += [(tuple_id, c.number, ordinal, way, kind, payload, c.phase, c.handshake, c.close) for kind in kinds]
    return out


def tcp_rows(frames: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """TCP segments as walk() reads them, behind the columns in `also`."""
    rows = with_tuple(frames.where("proto = 'tcp'"))
    shift = F.col("win_shift") if "win_shift" in frames.columns else F.lit(None).cast("int")
    tuple_id = F.concat_ws("|", F.col("a.ip"), F.col("a.port").cast("string"), F.col("b.ip"), F.col("b.port").cast("string"))
    kept = [F.col(c) for c in also]
    return rows.select(*kept, tuple_id.alias("tuple_id"), "ordinal", F.when(F.col("src") == F.col("a"), 0).otherwise(1).alias("way"), "seq", "ack", "flags", F.col("payload_len").alias("payload"), F.col("win_size").alias("win"), shift.alias("shift"))


def _walk_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tuple_id, ordinal): one state at a time, however long a tuple is."""
    names = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    current, state = None, TupleState()
    for batch in batches:
        out = []
        for tuple_id, ordinal, way, seq, ack, flags, payload, window, shift in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if tuple_id != current:
                current, state = tuple_id, TupleState()
            out += walk(tuple_id, [(ordinal, way, seq, ack, flags, payload, window or 0, shift)], state)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def connection_events(frames: DataFrame) -> DataFrame:
    """Typed events of every TCP connection. A tuple's segments go through one task in order (the recurrence needs
    that) as a stream: memory holds one tuple's state, never its segments."""
    rows = tcp_rows(frames).repartition("tuple_id").sortWithinPartitions("tuple_id", "ordinal")
    return rows.mapInArrow(_walk_sorted, EVENT_SCHEMA)


def connections(events: DataFrame) -> DataFrame:
    """One row per incarnation: final phase, handshake, close reason, and counts of its events."""
    last = lambda c: F.max_by(c, "ordinal").alias(c)
    return events.groupBy("tuple_id", "incarnation").agg(
        F.min("ordinal").alias("first_ordinal"), last("phase"), last("handshake"), last("close"), F.count("*").alias("events"), F.sum(F.when(F.col("kind") == "payloadObserved", 1).otherwise(0)).alias("payloads")
    )
