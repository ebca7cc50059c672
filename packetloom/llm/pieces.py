"""Sampled SentencePiece segmentation by forward filtering and backward sampling over the piece lattice.

A text is written with a leading word mark and `▁` for spaces, and cut where no piece can span the cut: before
each run of marks, and around newlines. A word between cuts has any length. In its lattice an arc is a vocabulary
piece; a character without a piece is an arc of its UTF-8 byte pieces. Forward filtering sums the weights of all
segmentations up to each position, over a sliding window of the longest piece and scaled to the last position, so
that no length under- or overflows; backward sampling draws the last piece in proportion, and so on to the start.
The random numbers are a hash of (seed, row key, word number, step): a row's segmentation does not depend on its
neighbours, partitions or retries. All words of a batch go through numpy together; equal words share a lattice.

Decoding joins the pieces' bytes and drops the leading mark. It gives back exactly the text: a literal `▁` in
a text is spelled in bytes, so that it can't be taken for a space.

Defined cases: null and empty texts have no pieces and decode to an empty text. Rows of equal key and text get
the same pieces; a null key is a key like others. Very long texts are encoded whole; memory is about 130 bytes for
each character of distinct words. An empty table gives an empty result. Other columns pass through; the result
columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, mix64

MARK = 0x2581
NEWLINE = 10
#: Stands for a literal mark in a text; no piece has it.
LITERAL = 0x110000
BATCH_CHARS = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


@dataclass(frozen=True)
class SampleParams:
    #: Exponent on the piece probabilities: large values approach the single best segmentation.
    alpha: float = 1.0
    seed: int = 0
    #: Probability of one byte piece.
    byte_probability: float = 1e-6


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback: hashes by length, weights, bytes."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        usable = []
        for i in range(n):
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                if not piece.strip("▁") or m.get_score(i) > -1e8:
                    usable.append((i, piece, max(m.get_score(i), -float(n))))  # marks alone have no rank
        #: No piece holds a mark behind another character, so that texts may be cut before marks.
        self.cut_at_marks = not any("▁" in piece.lstrip("▁") for _, piece, _ in usable)
        # No piece may hold a newline: texts are cut there.
        usable = [x for x in usable if "\n" not in x[1]]
        # The model ranks its pieces; rank r gets a probability in proportion to 1 / (r + 100).
        p = np.zeros(n)
        for i, _, score in usable:
            p[i] = 1.0 / (100.0 - score)
        self.probability = p / p.sum()
        self.longest = max(len(piece) for _, piece, _ in usable)
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.prefix: list[np.ndarray] = []
        for size in range(1, self.longest + 1):
            own = [(int(hash_of(piece)), i) for i, piece, _ in usable if len(piece) == size]
            own.sort()
            h = np.array([x for x, _ in own], np.uint64)
            seen = np.zeros(1 << _BITS, bool)
            seen[(mix64(h) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((h, np.array([i for _, i in own], np.int32), seen))
            longer = np.array(sorted({int(hash_of(piece[:size])) for _, piece, _ in usable if len(piece) > size}), np.uint64)
            more = np.zeros(1 << _BITS, bool)
            more[(mix64(longer) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.prefix.append(more)


def hash_of(piece: str) -> np.uint64:
    h = 0
    for c in piece:
        h = (h * int(_M) + ord(c) + 1) % 2**64
    return np.uint64(h)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _utf8_bytes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes (n x 4) and their number for code points."""
    cp = np.where(cp == LITERAL, MARK, cp).astype(np.int64)
    n = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
    out = np.zeros((len(cp), 4), np.int64)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])
    for k in range(4):
        shift = 6 * np.maximum(n - 1 - k, 0)
        part = (cp >> shift) & 0x3F | 0x80
        first = np.where(n == 1, cp, (cp >> shift) | lead[n])
        out[:, k] = first if k == 0 else part
    return out, n


def lattice(chars: np.ndarray, word: np.ndarray, left: np.ndarray, vocab: Vocabulary, params: SampleParams):
    """chars of all distinct words; word: number of each char's word; left: chars from it to the word's end.
    Returns, for each node (word position) and piece length, the cumulative probability that the last piece up
    to the node has that length or less, and the pieces (-1: bytes, 0: none)."""
    n, width = len(chars), vocab.longest
    nodes = n + (int(word[-1]) + 1 if n else 0)
    cum = np.full((nodes, width), -np.inf, np.float32)  # logarithms of weights first
    piece = np.zeros((nodes, width), np.int32)
    log_p = params.alpha * np.log(np.where(vocab.probability > 0, vocab.probability, 1.0))
    at = np.arange(n)
    h = np.zeros(n, np.uint64)
    for size in range(1, width + 1):
        h = h * _M + chars[at + size - 1].astype(np.uint64) + np.uint64(1)
        slot = (mix64(h) >> np.uint64(64 - _BITS)).astype(np.int64)
        keys, ids, seen = vocab.tables[size - 1]
        hit = np.flatnonzero(seen[slot])
        if len(hit) and len(keys):
            where = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
            same = keys[where] == h[hit]
            hit, found = hit[same], ids[where[same]]
            end = at[hit] + word[at[hit]] + size
            piece[end, size - 1] = found
            cum[end, size - 1] = log_p[found]
        go = vocab.prefix[size - 1][slot] & (left[at] > size)
        at, h = at[go], h[go]
        if not len(at):
            break
    first = np.arange(n) + word + 1
    bare = np.flatnonzero(piece[first, 0] == 0)
    _, many = _utf8_bytes(chars[bare])
    piece[first[bare], 0] = -1
    cum[first[bare], 0] = params.alpha * many / 4 * np.log(params.byte_probability)
    start = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1]) if n else np.zeros(0, np.int64)
    base = start + np.arange(len(start))
    length = left[start]
    # Longest words first: those that reach position j are the first alive[j].
    by_length = base[np.argsort(-length, kind="stable")]
    alive = np.cumsum(np.bincount(length, minlength=1)[::-1])[::-1]
    # Logarithms of the totals at the last positions, nearest first, against the total of the nearest.
    recent = np.zeros((len(base), 1))
    for j in range(1, len(alive)):
        rows, reach = by_length[: alive[j]] + j, min(j, width)
        w = cum[rows, :reach] + recent[: len(rows)]
        top = w.max(axis=1, keepdims=True)
        np.exp(w - top, out=w)
        c = np.cumsum(w, axis=1)
        s = c[:, -1:]
        cum[rows, :reach] = c / s
        recent = np.concatenate([np.zeros((len(rows), 1)), recent[: len(rows), : width - 1] - (top + np.log(s))], axis=1)
    # Where less than the longest piece stands before a node, the rest of its table is full.
    for size in range(1, min(width, len(alive))):
        cum[by_length[: alive[size]] + size, size:] = 1.0
    return cum, piece, base, length


def stream(row_hash: np.ndarray, seed: int, word: np.ndarray) -> np.ndarray:
    """Where the random numbers of each word start."""
    return mix64(mix64(row_hash ^ mix64(np.full(1, seed, np.uint64))) + word.astype(np.uint64))


def uniform(counter: np.ndarray, step: int) -> np.ndarray:
    """Doubles from 0 to below 1."""
    return (mix64(mix64(counter + np.uint64(step)) + _M) >> np.uint64(11)).astype(np.float64) / 2.0**53


def encode_batch(texts: list[str], row_hash: np.ndarray, vocab: Vocabulary, params: SampleParams) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, one after another, and the number of ids of each."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    cps = np.frombuffer("".join("\n" + t for t in texts if t).encode("utf-32-le"), "<u4").astype(np.int64)
    doc_start = (np.cumsum(sizes) - sizes)[sizes > 0]
    cps[cps == MARK] = LITERAL
    cps[cps == 32] = MARK
    newline = cps == NEWLINE
    newline[doc_start] = False
    cps[doc_start] = MARK
    begins = newline.copy()
    begins[1:] |= newline[:-1]
    if vocab.cut_at_marks:
        begins[1:] |= (cps[1:] == MARK) & (cps[:-1] != MARK)
    begins[doc_start] = True
    starts = np.flatnonzero(begins)
    lens = np.diff(np.append(starts, len(cps)))
    place = np.arange(len(cps)) - np.repeat(starts, lens)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(lens.max() - 1, _M)]))
    wh = mix64(np.add.reduceat(mix64(cps.astype(np.uint64) + np.uint64(7)) * power[place], starts) + lens.astype(np.uint64))
    _, rep, inverse = np.unique(wh, return_index=True, return_inverse=True)
    if not np.array_equal(lens[rep][inverse], lens) or not np.array_equal(cps[np.repeat(starts[rep][inverse], lens) + place], cps):
        rep, inverse = np.arange(len(starts)), np.arange(len(starts))  # two words of one hash: share nothing
    dl = lens[rep]
    word = np.repeat(np.arange(len(rep)), dl)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(dl) - dl, dl)
    chars = cps[starts[rep][word] + inside]
    cum, piece, base, length = lattice(chars, word, dl[word] - inside, vocab, params)

    # Backward sampling of all words in step.
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    first_word = np.searchsorted(starts, doc_start)
    rows = np.flatnonzero(sizes > 0)
    counter = stream(row_hash[rows][doc], params.seed, np.arange(len(starts)) - first_word[doc])
    active, node = np.arange(len(starts)), base[inverse] + length[inverse]
    left = length[inverse].copy()
    steps = []
    step = 0
    while len(active):
        # In double precision u stays below 1, where every table ends: the first entry above u is an arc with weight.
        size = (cum[node] <= uniform(counter[active], step)[:, None]).sum(axis=1) + 1
        got = piece[node, size - 1].astype(np.int64)
        steps.append((active, got, starts[active] + left - size))
        left = left - size
        node = node - size
        go = left > 0
        active, node, left = active[go], node[go], left[go]
        step += 1
    emitted = []
    per_word = np.zeros(len(starts), np.int64)
    for occ, got, char in steps:
        raw = np.flatnonzero(got < 0)
        e = np.ones(len(occ), np.int64)
        spelled, many = _utf8_bytes(cps[char[raw]])
        e[raw] = many
        per_word[occ] += e
        emitted.append((raw, spelled, e))
    tail = np.cumsum(per_word)
    out = np.zeros(int(tail[-1]), np.int32)
    for (occ, got, _), (raw, spelled, e) in zip(steps, emitted, strict=True):
        tail[occ] -= e
        whole = got >= 0
        out[tail[occ[whole]]] = got[whole]
        for k in range(4):
            r = raw[e[raw] > k]
            out[tail[occ[r]] + k] = vocab.byte_id[spelled[e[raw] > k, k]]
    counts = np.zeros(len(texts), np.int64)
    np.add.at(counts, rows[doc], per_word)
    return out, counts


def decode_ids(ids: list[int], vocab: Vocabulary) -> str:
    return b"".join(map(vocab.bytes.__getitem__, ids))[1:].decode("utf-8") if ids else ""


def _text_batches(texts: list[str]):
    low = total = 0
    for i, t in enumerate(texts):
        if i > low and total + len(t) > BATCH_CHARS:
            yield low, i
            low, total = i, 0
        total += len(t)
    if low < len(texts):
        yield low, len(texts)


def encode(df: DataFrame, model_path: str, key: Column, text_col: str = "text", params: SampleParams = SampleParams()) -> DataFrame:
    """df with ids (sampled pieces), n_pieces and lossless (decoding gave the text back)."""
    made = ("ids", "n_pieces", "lossless")
    kept = [c for c in df.columns if c not in made]
    base = df.select(*kept, F.xxhash64(key).alias("key_hash_"))
    fields = [f for f in base.schema.fields if f.name != "key_hash_"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())])

    def run(batches):
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            hashes = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64)
            for low, high in _text_batches(texts):
                ids, counts = encode_batch(texts[low:high], hashes[low:high], vocab, params)
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = ids.tolist()
                same = [decode_ids(flat[a:b], vocab) == t for a, b, t in zip(ends[:-1].tolist(), ends[1:].tolist(), texts[low:high], strict=True)]
                part = batch.slice(low, high - low)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(counts), pa.array(same, pa.bool_())], names=[f.name for f in schema])

    return bounded_batches(base).mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text that the pieces in ids_col spell."""
    base = df.select(*[c for c in df.columns if c != out_col])
    schema = T.StructType([*base.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches):
        vocab = vocabulary(model_path)
        for batch in batches:
            texts = [decode_ids(x or [], vocab) for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return bounded_batches(base).mapInArrow(run, schema)
