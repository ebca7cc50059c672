"""Exact Jaccard self-join on word shingles by universe-partition pigeonhole.

Two sets with Jaccard >= p % differ in at most d = floor(2 * size * (100 - p) / (100 + p)) elements. Sets
are put into size bands such that a linked pair lies in one band or in neighbouring ones. In a band the
universe of shingles is hashed into m segments, and segment i is looked up with strength v_i: 0 not at all,
1 the segment as it is, 2 the segment and its one-deletion neighbourhood (finds one differing element). If
the strengths of the segments that a set really looks up sum to d + 1 or more, a linked pair must agree on
one of them. Bands with a small d index subsets of m - d whole segments instead. `allocate` picks the
strengths from collision counts on a bounded pilot sample: they change the work, never the result.

Under an index key every set is a candidate partner of one of the others only, the one with the least hash; a task
does that before the shuffle already, for COMBINED keys at a time, so that a key of very many sets sends few rows a task. Each candidate is verified on
the whole sets, and links make components. A key that then holds sets of several components is open: in further
rounds its sets are paired with another one of its sets in a component other than theirs, drawn anew for each key
and round. So each round's pairs grow with the keys, near copies are one component after a round or two, and a key
closes as soon as its sets are in one. What is still open after that (sets that share a key and are not similar, as
with a common passage) is settled by a second exact filter: an index of these sets' rarest shingles with a bound by
position, for pairs in different components only, its large keys cut into blocks.

Defined cases: null and empty texts, and texts without a word, have the empty set and no links. A text with
fewer than k words is one shingle. Equal sets are linked. Rows with one id are rows of their own: each has the
component of its own text. Very long texts are sets like all others. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import BROADCAST_ROWS, bounded_batches, chunks, materialize, mix64, small, text_bytes
from packetloom.llm.components import connected_components
from packetloom.plans.tables import release_shuffles, scratch

_U = np.uint64
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Sets that the cost estimate looks at.
PILOT_SETS = 1_000
#: Counters of the shingle-frequency sketch that orders shingles from rare to frequent (4 MB).
SKETCH = 1 << 20
SKETCH_BLOCK = 1 << 14
#: Bytes of text that are hashed at once: their arrays fit into a core's cache.
HASHED_BYTES = 1 << 16
#: Bytes of text, and elements of sets, that a task takes up at once. What it holds and returns grows with them.
TAKEN_BYTES = 1 << 20
TAKEN = 1 << 17
#: Index keys that a task combines at once before they are shuffled; rows of keys that it combines after it.
COMBINED = 1 << 18
MET_ROWS = 1 << 15
#: Buckets of a set's sketch; of a finer one at most, which sets have that are too large for so few buckets.
SET_SKETCH = 256
FINE_SKETCH = 1 << 14
#: Rounds of drawn pairs under open keys.
ROUNDS = 3
#: Share of links among drawn pairs at which the rounds end.
FEW_LINKS = 0.01
#: Sets under one rare shingle that one task compares with one another.
BLOCK = 2048


_ODD = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _short_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(2 * HASHED_BYTES, _ODD), _powers(2 * HASHED_BYTES, pow(_ODD, -1, 2**64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (maximal runs without ASCII white space) and each text's first word index."""
    sizes = np.array([len(x) + 1 for x in texts])
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    white = (data == 32) | (data - np.uint8(9) < 5)
    turns = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, ends = turns[::2], turns[1::2]
    # A word's hash is the sum of its bytes' numbers times powers of an odd number by place: a difference of two running
    # sums over the whole text, brought to the word's own places by the inverse power of its start.
    power, inverse = _short_powers() if len(data) <= 2 * HASHED_BYTES else (_powers(len(data), _ODD), _powers(len(data), pow(_ODD, -1, 2**64)))
    run = _BYTE[data]
    run *= power[: len(data)]
    np.cumsum(run, out=run)
    h = mix64((run[ends - 1] - run[first - 1]) * inverse[first] + (ends - first).astype(np.uint64))
    return h, np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]) + 1)


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    x = np.sort(x)
    new = np.empty(len(x), bool)
    new[:1] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; fewer than k words are one shingle."""
    for part in chunks([len(x) for x in texts], HASHED_BYTES):
        h, cuts = word_hashes(texts[part])
        s = np.zeros(max(0, len(h) - k + 1), np.uint64)
        for j in range(k):
            s *= _U(0x9FB21C651E98DF25)
            s += h[j : j + len(s)]
        s = mix64(s)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= k:
                yield distinct(s[a : b - k + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    x = mix64(x * _U(0x9FB21C651E98DF25) + h[j : j + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)


def set_key(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _id64(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


@dataclass(frozen=True)
class Scheme:
    """How one size band is indexed."""

    band: int
    most: int  # differing elements of a linked pair
    segments: int
    subset: int = 0  # above 0: look up all subsets of so many segments
    strength: tuple[int, ...] = ()


@lru_cache(maxsize=8)
def band_starts(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of each band: a set's linked partners lie in its own band or a neighbouring one."""
    out = [1, 2]
    while out[-1] < most:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return out


def band_of(size: int, percent: int) -> int:
    return bisect_right(band_starts(percent), size) - 1


def default_scheme(band: int, percent: int) -> Scheme | None:
    starts = band_starts(percent)
    top = starts[band + 1] - 1
    d = 2 * top * (100 - percent) // (100 + percent)
    if d == 0:
        return None  # only equal sets are linked, and those are one class already
    if d <= 3:
        return Scheme(band, d, d + 2, subset=2)
    # Spare segments make up for those that are empty in a set by chance.
    spare = 2 if d < 16 else 3 if d < 64 else 4
    m = d + 1 + spare
    return Scheme(band, d, m, strength=(1,) * m)


def segment_of(x: np.ndarray, scheme: Scheme) -> np.ndarray:
    salted = mix64(x ^ _U(0xA0761D6478BD642F * (scheme.band + 1) % 2**64))
    return ((salted >> _U(32)) * _U(scheme.segments) >> _U(32)).astype(np.int64)


def signatures(x: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The index keys of set x in a band."""
    return band_signatures(x, np.array([len(x)]), scheme)[0]


def band_signatures(x: np.ndarray, sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """The index keys in a band of sets that stand one after the other in x, and which of the sets each key is of."""
    m, sets = scheme.segments, len(sizes)
    seg, val = segment_of(x, scheme), mix64(x + _U(0x2545F4914F6CDD1D))
    of = np.repeat(np.arange(sets), sizes)
    place = of * m + seg
    held = np.bincount(place, minlength=sets * m)
    total = np.zeros(sets * m, np.uint64)
    np.add.at(total, place, val)
    tag = mix64(np.arange(m, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(scheme.band * 2 + 1))
    if scheme.subset:
        pick = np.array(list(combinations(range(m), scheme.subset)))
        tagged = mix64(total.reshape(sets, m) + tag)
        return mix64(tagged[:, pick].sum(axis=2, dtype=np.uint64) + _U(scheme.band)).ravel(), np.repeat(np.arange(sets), len(pick))
    v = np.array(scheme.strength)
    looked = np.tile(v > 0, sets)
    present = np.flatnonzero((held > 0) & looked)
    out, whose = [mix64(total[present] + tag[present % m])], [present // m]
    # Too many empty segments (a single element is worth no more than 1): look the empty ones up too,
    # for partners that also have too many.
    short = np.minimum(np.tile(v, sets), held).reshape(sets, m).sum(axis=1) <= scheme.most
    if short.any():
        empty = np.flatnonzero((held == 0) & looked & np.repeat(short, m))
        out.append(mix64(tag[empty % m]))
        whose.append(empty // m)
    if (v == 2).any():
        two = np.flatnonzero(v[seg] == 2)
        out.append(mix64(total[place[two]] - val[two] + tag[seg[two]]))
        whose.append(of[two])
    return np.concatenate(out), np.concatenate(whose)


def allocate(scheme: Scheme, pilot: list[np.ndarray], weight: float) -> Scheme:
    """Move strength from segments whose keys collide often to ones with few elements, while the estimated
    cost (keys stored plus weight times pairs met under them) falls. The sum of strengths stays."""
    if scheme.subset or len(pilot) < 2:
        return scheme
    one, two = _segment_costs(scheme, pilot, weight)
    strength = np.ones(scheme.segments, int)
    giving, taking = np.argsort(-one, kind="stable"), np.argsort(two - one, kind="stable")
    at = 0
    for down in giving:
        while at < len(taking) and (strength[taking[at]] != 1 or taking[at] == down):
            at += 1
        if strength[down] != 1 or at == len(taking) or one[down] <= two[taking[at]] - one[taking[at]]:
            break
        strength[down], strength[taking[at]] = 0, 2
    return Scheme(scheme.band, scheme.most, scheme.segments, strength=tuple(int(v) for v in strength))


def _segment_costs(scheme: Scheme, pilot: list[np.ndarray], weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each segment at strength 1 and at strength 2, a set of the pilot."""
    whole, less = [], []
    for x in pilot:
        seg, val = segment_of(x, scheme), mix64(x)
        total = np.zeros(scheme.segments, np.uint64)
        np.add.at(total, seg, val)
        present = np.unique(seg)
        whole.append((present, total[present]))
        less.append((seg, total[seg] - val))

    def cost(entries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        seg, key = (np.concatenate(c) for c in zip(*entries, strict=True))
        order = np.lexsort((key, seg))
        seg, key = seg[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (key[1:] != key[:-1])]))
        c = np.diff(np.append(first, len(seg))).astype(float)
        stored, met = np.bincount(seg, minlength=scheme.segments), np.bincount(seg[first], c * (c - 1), minlength=scheme.segments)
        return (stored + weight * met) / len(pilot)

    return cost(whole), cost([*whole, *less])


def plan(df: DataFrame, text_col: str, id_col: str, percent: int, k: int, pilot_sets: int = PILOT_SETS) -> dict[int, Scheme]:
    """Schemes that the pilot sample changes; bands not named here use default_scheme."""
    rows = df.count()
    if not rows:
        return {}
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1_000_000)) < F.lit(min(1.0, pilot_sets / rows) * 1_000_000)
    texts = [r[0].lower() for r in df.where(drawn).select(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).limit(2 * pilot_sets).collect()]
    by_band: dict[int, dict[bytes, np.ndarray]] = {}
    for x in shingle_sets([bytes(t) for t in texts], k):
        if len(x):
            by_band.setdefault(band_of(len(x), percent), {})[set_key(x)] = x
    out = {}
    for band, sets in by_band.items():
        base = default_scheme(band, percent)
        if base:
            got = allocate(base, list(sets.values()), weight=rows / max(1, len(texts)))
            if got != base:
                out[band] = got
    return out


# ---- Spark stages -----------------------------------------------------------------------------------------


def _batches(batches, text_at: int, k: int):
    """(batch slice, its sets), in slices of bounded text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        for at in chunks(sizes, TAKEN_BYTES):
            part = batch.slice(at.start, at.stop - at.start)
            yield part, shingle_sets([t.lower() for t in text_bytes(part.column(text_at))], k)


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """docs (id, text, text_hash) -> id, text_hash, n, key (16-byte digest of the set), h (its first 8 bytes)."""

    def run(batches):
        for part, sets in _batches(batches, 1, k):
            n, key = [], []
            for x in sets:
                n.append(len(x))
                key.append(set_key(x))
            h = [_id64(y) for y in key]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(h, pa.int64())], names=["id", "text_hash", "n", "key", "h"])

    return docs.mapInArrow(run, "id long, text_hash long, n long, key binary, h long")


def _fit(percent: int, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(na, nb).astype(np.int64) >= percent * np.maximum(na, nb).astype(np.int64)


def absorb(sig: np.ndarray, h: np.ndarray, n: np.ndarray, more: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Under each key: pairs of the set with the least hash and every other one of fitting size, which then need not go
    on; sets of other sizes do the same among themselves. Returns the places of the rows that go on, in order, whether
    each row (by place) stands for others, and the distinct pairs."""
    order = np.argsort(sig)
    same = sig[order][1:] == sig[order][:-1]
    shared = np.concatenate([same, [False]])[: len(sig)] | np.concatenate([[False], same])[: len(sig)]
    some, more = order[shared], more.copy()  # hardly any keys are shared
    left = some[np.lexsort((~more[some], h[some], sig[some]))]
    left = left[np.concatenate([[True], (sig[left][1:] != sig[left][:-1]) | (h[left][1:] != h[left][:-1])])[: len(left)]]
    heads, pairs = [order[~shared]], [np.zeros((0, 2), np.int64)]
    while len(left):
        first = np.concatenate([[True], sig[left][1:] != sig[left][:-1]])
        head = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
        gone = ~first & _fit(percent, n[left], n[head])
        pairs.append(np.stack([h[left[gone]], h[head[gone]]], 1))
        more[head[gone]] = True
        heads.append(left[first])
        left = left[~first & ~gone]
    found = np.concatenate(pairs)
    return np.sort(np.concatenate(heads)), more, np.unique(found, axis=0) if len(found) else found


def index_keys(docs: DataFrame, percent: int, k: int, schemes: dict[int, Scheme]) -> DataFrame:
    """docs (id, text) -> rows of two kinds. Index keys: sig, h, n (negative: the set stands for others, see absorb). Pairs
    met in this task: h, n = 0 and a sig from which met_pairs gets the other set back."""
    names = ["sig", "h", "n"]

    def run(batches):
        met: set[bytes] = set()
        known, held, size = dict(schemes), [], 0
        new: list[np.ndarray] = []
        names_of: list[int] = []
        elements = 0

        def keys_of_new() -> int:
            s, whose = all_signatures(new, percent, known)
            held.append((s, np.array(names_of, np.int64)[whose], np.array([len(x) for x in new], np.int32)[whose]))
            new.clear()
            names_of.clear()
            return len(s)

        def combined() -> Iterator[pa.RecordBatch]:
            sig, h, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            sig = sig.view(np.int64)
            on, more, pairs = absorb(sig, h, n, np.zeros(len(sig), bool), percent)
            # In the order of sets, which packs well.
            yield pa.RecordBatch.from_arrays([pa.array(sig[on]), pa.array(h[on]), pa.array(np.where(more[on], -n[on], n[on]))], names=names)
            if len(pairs):
                a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
                yield pa.RecordBatch.from_arrays([pa.array(b ^ mixed_name(a)), pa.array(a), pa.array(np.zeros(len(a), np.int32))], names=names)

        for _, sets in _batches(batches, 1, k):
            for x in sets:
                if not len(x) or (key := set_key(x)) in met:
                    continue
                met.add(key)
                new.append(x)
                names_of.append(_id64(key))
                elements += len(x)
                if elements >= TAKEN:
                    size, elements = size + keys_of_new(), 0
                    if size >= COMBINED:
                        yield from combined()
                        size = 0
        if new:
            keys_of_new()
        if held:
            yield from combined()

    return docs.mapInArrow(run, "sig long, h long, n int")


def mixed_name(h: np.ndarray) -> np.ndarray:
    return mix64(h.view(np.uint64)).view(np.int64)


def all_signatures(sets: list[np.ndarray], percent: int, known: dict[int, Scheme | None]) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of sets in their own bands and the ones above, set after set, and the place of each key's set; known:
    schemes by band, filled up here."""
    by_band: dict[int, list[int]] = {}
    for i, x in enumerate(sets):
        band = band_of(len(x), percent)
        for b in (band, band + 1):
            by_band.setdefault(b, []).append(i)
    out, whose = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, some in by_band.items():
        if b not in known:
            known[b] = default_scheme(b, percent)
        if known[b] is not None:
            keys, of = band_signatures(np.concatenate([sets[i] for i in some]), np.array([len(sets[i]) for i in some]), known[b])
            out.append(keys)
            whose.append(np.array(some)[of])
    keys, of = np.concatenate(out), np.concatenate(whose)
    order = np.argsort(of.astype(np.uint16) if len(sets) <= 1 << 16 else of, kind="stable")
    return keys[order], of[order]


def meet(keys: DataFrame, percent: int) -> DataFrame:
    """index_keys()'s rows -> distinct (a, b): pairs met under a key; (a, null): a set under a key with others, paired
    with none of them for its size. Rows stream through in order of keys; a key's rows are combined as they come."""

    def run(batches):
        held = None
        for sig, h, n in several_batches(batches, MET_ROWS):
            pair = n == 0
            if pair.any():
                yield pa.RecordBatch.from_arrays([pa.array(h[pair]), pa.array(sig[pair] ^ mixed_name(h[pair]))], names=["a", "b"])
                sig, h, n = (c[~pair] for c in (sig, h, n))
            rows = [sig, h, abs(n), n < 0]
            if held is not None:
                rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
            on, more, pairs = absorb(*rows, percent)
            rows = [*(c[on] for c in rows[:3]), more[on]]
            last = np.searchsorted(rows[0], rows[0][-1]) if len(on) else 0
            yield from settled(*(c[:last] for c in rows[:2]), rows[3][:last], pairs)
            held = [c[last:] for c in rows]
        if held is not None:
            yield from settled(held[0], held[1], held[3], np.zeros((0, 2), np.int64))

    def settled(sig: np.ndarray, h: np.ndarray, more: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(sig)))
        busy = np.logical_or.reduceat(more, first) if len(first) else np.zeros(0, bool)
        marked = np.unique(h[np.repeat((count > 1) & busy, count) & ~more])
        left = np.concatenate([pairs[:, 0], marked])
        right = pa.array(np.concatenate([pairs[:, 1], np.zeros(len(marked), np.int64)]), mask=np.arange(len(left)) >= len(pairs))
        if len(left):
            yield pa.RecordBatch.from_arrays([pa.array(left), right], names=["a", "b"])

    return keys.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long").distinct()


def several_batches(batches, rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of consecutive batches without nulls, of so many rows at least (the last: of what is left)."""
    held, size = [], 0
    for batch in batches:
        held.append([c.to_numpy() for c in batch.columns])
        size += batch.num_rows
        if size >= rows:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def set_sketch(x: np.ndarray, buckets: int = SET_SKETCH) -> bytes:
    """How many elements fall into each of a number of buckets, 255 at most. The sum of two sketches' differences is
    never more than the number of elements in which their sets differ."""
    slot = (mix64(x + _U(0x632BE59BD9B4E019)) % _U(buckets)).astype(np.int64)
    return np.minimum(np.bincount(slot, minlength=buckets), 255).astype(np.uint8).tobytes()


def fine_sketch(x: np.ndarray) -> bytes | None:
    """The sketch of a set that has more than four elements for each bucket of the plain one: two to four for a bucket."""
    buckets = min(FINE_SKETCH, 1 << ((len(x) - 1) // 4).bit_length())
    return set_sketch(x, buckets) if buckets > SET_SKETCH else None


def sketches_apart(x: bytes, y: bytes) -> int:
    """Elements in which two sets with these sketches differ, at the least. The number of buckets is a power of two, so the
    longer one folds to the shorter one's buckets."""
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in (x, y))
    m = min(len(a), len(b))
    return int(np.abs(a.reshape(-1, m).sum(axis=0) - b.reshape(-1, m).sum(axis=0)).sum())


def candidate_sets(docs: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """The whole sets of the classes in reps (id: of one row that has the set; h): h, n, sketch, fine (fine_sketch), items."""

    def run(batches):
        for part, sets in _batches(batches, 0, k):
            got, want = list(sets), part.column(1).to_pylist()
            # An id may have other texts too.
            got = [(h, x) for h, x in zip(want, got, strict=True) if len(x) and _id64(set_key(x)) == h]
            if got:
                ends = np.concatenate([[0], np.cumsum([len(x) for _, x in got])]).astype(np.int32)
                values = pa.array(np.concatenate([x for _, x in got]).view(np.int64))
                counts, fine = (pa.array([f(x) for _, x in got], pa.binary()) for f in (set_sketch, fine_sketch))
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in got]), pa.array([len(x) for _, x in got], pa.int64()), counts, fine, pa.ListArray.from_arrays(pa.array(ends), values)], names=["h", "n", "sketch", "fine", "items"])

    def of(some: DataFrame) -> DataFrame:
        return docs.join(small(some.select("id", "h"), some.count()), "id").select("text", "h").mapInArrow(run, "h long, n long, sketch binary, fine binary, items array<long>")

    again = reps.where("copies > 1")
    found = of(reps.where("copies = 1"))
    return found.union(of(again).dropDuplicates(["h"])) if again.count() else found


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How often shingles of each hash slot occur, summed over all tasks; 4 MB at any input size."""

    def run(batches):
        count = np.zeros(SKETCH, np.int32)
        for b in batches:
            x = b.column(0).flatten().to_numpy().view(np.uint64)
            count += np.bincount((mix64(x) % _U(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.int32)
        for i in range(0, SKETCH, SKETCH_BLOCK):
            if (block := count[i : i + SKETCH_BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SKETCH_BLOCK], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["block", "counts"])

    def add(key, table):
        total = np.zeros(SKETCH_BLOCK, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        summed = total.clip(max=2**31 - 1).astype(np.int32).tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([summed], pa.binary())})

    rows = sets.select("items").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary").collect()
    out = np.zeros(SKETCH, np.int32)
    for r in rows:
        out[r.block * SKETCH_BLOCK : (r.block + 1) * SKETCH_BLOCK] = np.frombuffer(r.counts, np.int32)
    return out


def of_bounded_sets(batches) -> Iterator[pa.RecordBatch]:
    """The batches (h, n, items, comp) in slices whose sets have a bounded number of elements together."""
    for batch in batches:
        for at in chunks(batch.column(1).to_pylist(), TAKEN):
            yield batch.slice(at.start, at.stop - at.start)


def rare_prefixes(sets: DataFrame, sketch, percent: int) -> DataFrame:
    """sets (h, n, items, comp) -> one row for each of the rarest shingles that any linked partner must share
    one of: token, h, n, pos, comp."""

    def run(batches):
        freq = sketch.value
        for batch in of_bounded_sets(batches):
            hs, ns, comps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            out = []
            for me, n, comp, items in zip(hs, ns, comps, batch.column(2), strict=True):
                x = items.values.to_numpy().view(np.uint64)
                mixed = mix64(x)
                order = np.lexsort((mixed, freq[(mixed % _U(SKETCH)).astype(np.int64)]))
                keep = int(n) - (percent * int(n) + 99) // 100 + 1
                t = x[order[:keep]].view(np.int64)
                out.append((t, np.full(len(t), me), np.full(len(t), n), np.arange(len(t)), np.full(len(t), comp)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "h", "n", "pos", "comp"])

    return sets.select("h", "n", "items", "comp").mapInArrow(run, "token long, h long, n long, pos long, comp long")


def in_blocks(prefixes: DataFrame, block: int = BLOCK) -> DataFrame:
    """prefixes of shingles under which several components meet, with cell and side: rows of one (token, cell) are to be
    compared, across sides where they have two. Under a shingle with more than `block` rows the largest component's
    rows stand in blocks on one side (1) and the others' on the other (0), and the others' blocks meet in pairs, so
    that no cell holds more than about two blocks and only rows of other components are repeated for each other."""
    spread = prefixes.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"))
    spread = materialize(spread.where("lo < hi").select("token", "rows"), "spread")
    shared = prefixes.join(small(spread, spread.count()), "token")
    light = shared.where(F.col("rows") <= block).select(*prefixes.columns, F.lit(0).cast("long").alias("cell"), F.lit(None).cast("int").alias("side"))
    heavy = shared.where(F.col("rows") > block).drop("rows")
    top = heavy.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    top = top.select("token", F.col("m.comp").alias("most"), F.ceil(F.col("m.c") / block).alias("s"), F.ceil((F.col("all") - F.col("m.c")) / block).alias("r"))
    rows = heavy.join(top, "token").withColumn("own", F.col("comp") == F.col("most"))
    number = F.pmod(F.xxhash64("h", F.lit(21)), F.when(F.col("own"), F.col("s")).otherwise(F.col("r")))
    rows = rows.withColumn("block", number)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # Cells of the two sides, then of pairs of the others' blocks (one block with itself has no sides).
    across = F.when(F.col("own"), F.transform(up_to(F.col("r")), lambda x: F.struct((x * F.col("s") + F.col("block")).alias("cell"), F.lit(1).alias("side")))).otherwise(
        F.transform(up_to(F.col("s")), lambda x: F.struct((F.col("block") * F.col("s") + x).alias("cell"), F.lit(0).alias("side")))
    )
    among = F.transform(
        up_to(F.col("r")),
        lambda x: F.struct((-1 - F.least(x, "block") * F.col("r") - F.greatest(x, "block")).alias("cell"), F.when(x == F.col("block"), F.lit(None)).otherwise((x < F.col("block")).cast("int")).alias("side")),
    )
    cells = F.when(F.col("own"), across).otherwise(F.concat(across, among))
    return light.union(rows.withColumn("at", F.explode(cells)).select(*prefixes.columns, "at.cell", "at.side"))


def crossing_pairs(prefixes: DataFrame, percent: int, block: int = BLOCK, sets: DataFrame | None = None) -> DataFrame:
    """Pairs of sets in different components that share a rare shingle and can still reach the threshold. sets (h, sketch):
    pairs that their sketches rule out are left out where they meet, so that sets that share a passage and are not similar
    make no rows."""

    sketched = sets is not None

    def pairs_of(cols: list[np.ndarray]) -> np.ndarray:
        token, h, n, pos, comp, cell, side = cols[:7]
        counts = np.frombuffer(b"".join(cols[7]), np.uint8).reshape(-1, SET_SKETCH).astype(np.int16) if sketched else None
        first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
        found, held = [], 0
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(token)], strict=True):
            for i in range(lo, hi - 1):
                j = np.arange(i + 1, hi)
                j = j[(comp[j] != comp[i]) & ((side[j] != side[i]) | (side[i] < 0))]
                # The most that both can share if this shingle is the first that they do.
                most = 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
                j = j[100 * most >= percent * (n[i] + n[j] - most)]
                if sketched and len(j):
                    j = j[np.abs(counts[j] - counts[i]).sum(axis=1) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)]
                if len(j):
                    found.append(np.stack([np.full(len(j), h[i]), h[j]], 1))
                    held += len(j)
                if held > 1_000_000:
                    found = [np.unique(np.sort(np.concatenate(found), axis=1), axis=0)]
                    held = 0
        return np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)

    def run(batches):
        for cols in whole_groups(batches, 0, 5):
            p = pairs_of(cols)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    rows = in_blocks(prefixes, block).withColumn("side", F.coalesce("side", F.lit(-1)))
    rows = rows.select("token", "h", "n", "pos", "comp", "cell", "side")
    if sketched:
        rows = rows.join(sets.select("h", "sketch"), "h").select(*rows.columns, "sketch")
    rows = rows.repartition("token", "cell").sortWithinPartitions("token", "cell")
    return rows.mapInArrow(run, "a long, b long").distinct()


def whole_groups(batches, *keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no group of equal keys is divided."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate(c) for c in zip(held, cols, strict=True)]
        other = np.logical_or.reduce([cols[i] != cols[i][-1] for i in keys])
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None:
        yield held


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the sets' sketches don't rule out."""
    small_sets = sets.select("h", "n", "sketch")
    left = small_sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = small_sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(2).to_numpy() + b.column(4).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, SET_SKETCH).astype(np.int16) for i in (3, 5))
            apart = np.abs(x - y).sum(axis=1)
            yield b.select([0, 1]).filter(pa.array(apart * (100 + percent) <= n * (100 - percent)))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb")
    return finely_plausible(joined.mapInArrow(run, "a long, b long"), sets, percent)


def finely_plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that fine sketches don't rule out. A plain sketch of a set of some 7 000 elements says nothing: any
    two such sketches are as near to each other as those of a linked pair."""
    fine = sets.select("h", "n", "fine")
    left = fine.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("fine").alias("fa"))
    right = fine.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("fb"))

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(4).to_numpy()
            two = zip(b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True)
            apart = np.array([sketches_apart(x, y) if x and y else 0 for x, y in two], np.int64)
            yield b.select([0, 1]).filter(pa.array(apart * (100 + percent) <= n * (100 - percent)))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "fa", "nb", "fb")
    return joined.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Whole sets are moved only where sketches allow a link."""
    pairs = materialize(plausible(pairs, sets, percent), label)
    release_shuffles(pairs.sparkSession)
    ids = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    sets = sets.join(small(ids, 2 * pairs.count()), "h", "left_semi")
    return materialize(similar(pairs, sets, percent, None), f"{label}-links")


def verified_in_slices(pairs: DataFrame, sets: DataFrame, percent: int, label: str, slices: int) -> DataFrame:
    """verified(), a slice of the pairs at a time, so that only a part of the sets is in shuffle files at once. Few pairs
    are moved in fewer slices."""
    pairs = materialize(plausible(pairs, sets, percent), label)
    found, slices = None, min(slices, 1 + pairs.count() // SLICE_PAIRS)
    for i in range(slices):
        release_shuffles(pairs.sparkSession)
        part = pairs.where(F.pmod(F.xxhash64("a", F.lit(29)), F.lit(slices)) == i)
        links = materialize(similar(part, sets, percent, part.count()), f"{label}-links")
        found = links if found is None else found.union(links)
    return found


def similar(pairs: DataFrame, sets: DataFrame, percent: int, n: int | None) -> DataFrame:
    """The pairs whose sets are similar enough. n: how many pairs there are, if they may be broadcast for it: the sets of side
    a then stay where they are read until they are sent to their partners'."""
    left = sets.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("items").alias("xa"))
    right = sets.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("items").alias("xb"))
    if n is not None:
        right = right.join(small(pairs.select("b").distinct(), n), "b", "left_semi")
    both = F.size(F.array_intersect("xa", "xb"))
    joined = (pairs.join(left, "a") if n is None else left.join(small(pairs, n), "a")).join(right, "b").select("a", "b", "na", "nb", both.alias("both"))
    return joined.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def joined_links(comps: DataFrame, links: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)


def with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with comp: the component of h, or h itself."""
    return rows.join(small(comps.select(F.col("node").alias("h"), "component"), comps.count()), "h", "left").withColumn("comp", F.coalesce("component", "h")).drop("component")


def set_keys(items: DataFrame, percent: int, schemes: dict[int, Scheme]) -> DataFrame:
    """items (h, n, items, comp) -> sig, h, n, comp: every index key of every set."""

    def run(batches):
        known = dict(schemes)
        for batch in of_bounded_sets(batches):
            keys, at = all_signatures([x.values.to_numpy().view(np.uint64) for x in batch.column(2)], percent, known)
            took = [batch.column(i).take(pa.array(at)) for i in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *took], names=["sig", "h", "n", "comp"])

    return items.select("h", "n", "items", "comp").mapInArrow(run, "sig long, h long, n long, comp long")


def open_keys(keys: DataFrame) -> DataFrame:
    """sig of each key that holds sets of several components."""
    return keys.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")


def drawn_pairs(keys: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of every set under an open key and the one that is drawn for the key, where sizes fit and components differ."""
    drawn = F.min_by(F.struct("h", "n", "comp"), F.xxhash64("h", "sig", F.lit(turn))).alias("other")
    one = keys.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), drawn).where("lo < hi").select("sig", "other")
    fits = 100 * F.least(F.col("n"), F.col("other.n")) >= percent * F.greatest(F.col("n"), F.col("other.n"))
    apart = keys.join(one, "sig").where((F.col("comp") != F.col("other.comp")) & fits)
    return apart.select(F.greatest("h", F.col("other.h")).alias("a"), F.least("h", F.col("other.h")).alias("b")).distinct()


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, slices: int = 1) -> DataFrame:
    """Per row of df that has an id: id, text_hash, n (set size), grp (the same for linked rows; null for an empty set)
    and component_id (the smallest id of its group). slices: parts in which whole sets are moved for comparison, one
    after another; more of them take less disk and more time."""
    docs = bounded_batches(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null"))
    sets = materialize(set_table(docs.withColumn("text_hash", F.xxhash64("text")), k), "sets", keep=True)
    # Written out, so that the last join has plain shuffles on both sides and a key with very many rows can be split.
    classes = sets.where("n > 0").groupBy("key", "id").agg(F.first("h").alias("h"), F.count("*").alias("copies"))
    classes = materialize(classes.groupBy("key").agg(F.first("h").alias("h"), F.min(F.struct("id", "copies")).alias("r")).select("key", "h", F.col("r.id").alias("rep"), F.col("r.copies").alias("copies")), "classes", keep=True)
    with scratch(df.sparkSession):
        by_class = materialize(class_groups(docs, classes, percent, k, slices), "by-class", keep=True)
    release_shuffles(df.sparkSession)
    return sets.join(by_class, "key", "left").select("id", "text_hash", "n", "grp", F.coalesce("least", "id").alias("component_id"))


def class_groups(docs: DataFrame, classes: DataFrame, percent: int, k: int, slices: int) -> DataFrame:
    """(key, grp, least) of every class of equal sets: its group, and the smallest id in it. Each phase's shuffle files go
    before the next phase writes its own."""
    spark = docs.sparkSession
    compare = verified if slices == 1 else partial(verified_in_slices, slices=slices)
    schemes = plan(docs, "text", "id", percent, k)
    met = materialize(meet(index_keys(docs, percent, k, schemes), percent), "met")
    wanted = met.select(F.col("a").alias("h")).union(met.where("b is not null").select("b")).distinct()
    release_shuffles(spark)
    reps = materialize(classes.join(wanted, "h").select(F.col("rep").alias("id"), "h", "copies"), "reps")
    items = materialize(candidate_sets(docs, reps, k), "items")

    release_shuffles(spark)
    comps = connected_components(compare(met.where("b is not null"), items, percent, "first"))
    release_shuffles(spark)
    keys = set_keys(with_component(items, comps), percent, schemes)
    still = materialize(open_keys(keys), "open")
    live = materialize(keys.join(small(still, still.count()), "sig", "left_semi").select("sig", "h", "n"), "live")
    rest = live
    for turn in range(ROUNDS):
        release_shuffles(spark)
        drawn = materialize(drawn_pairs(with_component(live, comps), percent, turn), "drawn")
        more = compare(drawn, items, percent, f"drawn{turn}")
        # Where hardly any drawn pair is a link, further ones would not be either; what there is joins the last links.
        if more.count() <= FEW_LINKS * drawn.count():
            break
        comps, more = connected_components(joined_links(comps, more)), None
        named = with_component(live, comps)
        rest = named.join(open_keys(named), "sig", "left_semi")
    sets_left = materialize(with_component(rest.select("h").distinct(), comps), "rest")
    release_shuffles(spark)
    # The whole sets stay where they are: a second copy would be as large as the texts. Too many rows to be sent to all tasks
    # are not joined; then all sets take part, of which settled ones find nothing new.
    few = sets_left.count() <= BROADCAST_ROWS
    left = items.join(F.broadcast(sets_left), "h") if few else with_component(items, comps)
    links = [more] if more is not None and not more.isEmpty() else []
    if not sets_left.isEmpty():
        sketch = spark.sparkContext.broadcast(frequency_sketch(left))
        links.append(compare(crossing_pairs(rare_prefixes(left, sketch, percent), percent, sets=items), items, percent, "rest-pairs"))
    links = [x for x in links if not x.isEmpty()]
    release_shuffles(spark)
    if links:
        comps = connected_components(joined_links(comps, reduce(DataFrame.union, links)))

    members = comps.union(comps.select(F.col("component").alias("node"), "component").distinct()).join(classes.select(F.col("h").alias("node"), "rep"), "node")
    least = members.groupBy("component").agg(F.min("rep").alias("least"))
    named = members.join(least, "component").select(F.col("node").alias("h"), F.col("component").alias("root"), "least")
    return classes.join(named, "h", "left").select("key", F.coalesce("root", "h").alias("grp"), F.coalesce("least", "rep").alias("least"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """Per row of df: id_col, n_shingles, component_id (the smallest id reachable by links). A row with a null id takes
    no part and is left out."""
    return jaccard_groups(df, id_col, text_col, k, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


#: Parts in which keep_one has whole sets moved, where there are so many pairs for each.
SLICES = 8
SLICE_PAIRS = 5_000


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of near duplicates: one with the smallest id, and of several rows with that id, or
    rows that repeat it, one of them, chosen by hashes of the texts and rows. Rows with no id or an empty set stay."""
    key = [id_col, "text_hash_"]
    groups = materialize(jaccard_groups(df, id_col, text_col, k, percent, slices=SLICES).where("grp IS NOT NULL"), "groups")
    stays = groups.where("id = component_id").groupBy("grp").agg(F.min("text_hash").alias("stays"), F.count("*").alias("rows"))
    leave = groups.join(stays, "grp").where((F.col("id") != F.col("component_id")) | (F.col("text_hash") != F.col("stays")))
    leave = materialize(leave.select(F.col("id").alias(id_col), F.col("text_hash").alias("text_hash_")).distinct(), "leave")
    n = leave.count()
    several = groups.join(stays.where("rows > 1"), "grp").where("id = component_id AND text_hash = stays").select(F.col("id").alias(id_col), F.col("text_hash").alias("text_hash_")).distinct()
    rows = df.withColumn("text_hash_", F.xxhash64(text_col))
    if several.isEmpty():
        return rows.join(small(leave, n), key, "left_anti").select(*df.columns)
    # Exact repeats of a row that stays: only such rows are gathered, by row.
    once = rows.join(several, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("row")).select("row.*")
    return rows.join(leave.union(several).distinct(), key, "left_anti").select(*df.columns).union(once)
