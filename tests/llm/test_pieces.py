"""Sampled segmentation against a plain sampler over the whole lattice, and the draws at the very edge."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from packetloom.llm import pieces
from packetloom.llm import queries as Q
from packetloom.llm.common import mix64
from packetloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
U64 = 2**64


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def known(vocab):
    """Piece text (marks as ▁) to (id, probability)."""
    return {vocab.bytes[i].decode().replace(" ", "▁"): (i, p) for i, p in enumerate(vocab.probability.tolist()) if p > 0}


def arcs(text, known, params):
    """For every end position: (start, id or None for bytes, weight)."""
    out = []
    for j in range(1, len(text) + 1):
        here = [(i, *known[text[i:j]]) for i in range(max(0, j - 16), j) if text[i:j] in known]
        if all(i < j - 1 for i, _, _ in here):
            here.append((j - 1, None, params.byte_probability ** (len(text[j - 1].encode()) / 4)))
        out.append(sorted(here, key=lambda a: -a[0]))
    return out


def words_of(text):
    """A text's words: cut before runs of spaces and around newlines; a literal mark stays apart."""
    out = [[]]
    marked = "▁" + text.replace("▁", chr(0x110000 - 1)).replace(" ", "▁")
    for i, c in enumerate(marked):
        new = (c == "\n" and i) or (i and marked[i - 1] == "\n" and i > 0) or (c == "▁" and i and marked[i - 1] != "▁")
        if new and out[-1]:
            out.append([])
        out[-1].append(c)
    return ["".join(w) for w in out]


def plain_sample(text, row_hash, known, vocab, params=pieces.SampleParams()):
    """Forward sums and backward draws in plain Python over one text, with the operator's random numbers."""
    ids = []
    for w, word in enumerate(words_of(text) if text else []):
        total, ways = [0.0], arcs(word, known, params)  # logarithms
        for here in ways:
            top = max(math.log(p) + total[i] for i, _, p in here)
            total.append(top + math.log(sum(math.exp(math.log(p) + total[i] - top) for i, _, p in here)))
        counter = pieces.stream(np.array([row_hash], np.uint64), params.seed, np.array([w]))
        at, step, back = len(word), 0, []
        while at:
            u, run = float(pieces.uniform(counter, step)[0]), 0.0
            for i, piece, p in ways[at - 1]:
                run += math.exp(math.log(p) + total[i] - total[at])
                if u < run:
                    break
            back.append([piece] if piece is not None else [int(vocab.byte_id[b]) for b in (word[at - 1] if word[at - 1] != chr(0x110000 - 1) else "▁").encode()])
            at, step = i, step + 1
        ids += [x for part in reversed(back) for x in part]
    return ids


def test_op6_against_the_plain_sampler(spark, vocab, known):
    t = pq.read_table(f"{SF}/documents.parquet")
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    hashes = {r.doc_id: r.h % U64 for r in spark.createDataFrame([(i,) for i in texts], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    short = {i for i, x in texts.items() if len(x or "") < 3000}
    got = {r.doc_id: r.ids for r in Q.QUERIES["op6_pieces"](spark, SF).collect()}
    assert set(got) == set(texts) and len(short) > 50
    for i in short:
        assert got[i] == plain_sample(texts[i] or "", hashes[i], known, vocab)


def test_unspaced_and_spaced_texts_against_the_plain_sampler(vocab, known):
    r = random.Random(4)
    texts = ["".join(r.choices("thecatisondogrunning", k=700)), "漢字仮名交じり文" * 60, "a  b    c" + " " * 40 + "d", "x\n\n  y\n z", " " * 9, "▁a ▁", "http://example.org/" + "abc/def?g=h&" * 20]
    rows = np.array([r.getrandbits(64) for _ in texts], np.uint64)
    ids, counts = pieces.encode_batch(texts, rows, vocab, pieces.SampleParams())
    ends = np.concatenate([[0], np.cumsum(counts)])
    for text, h, a, b in zip(texts, rows.tolist(), ends[:-1], ends[1:], strict=True):
        assert ids[a:b].tolist() == plain_sample(text, h, known, vocab)
        assert pieces.decode_ids(ids[a:b].tolist(), vocab) == text
    runs = Counter(vocab.bytes[i] for i in ids.tolist())
    assert any(p.strip() == b"" and len(p) > 1 for p in runs)


def unmix(x):
    inverse = pow(0xD6E8FEB86659FD93, -1, U64)
    x ^= x >> 32
    x = x * inverse % U64
    x ^= x >> 32
    x = x * inverse % U64
    return x ^ (x >> 32)


@pytest.mark.parametrize("draw", [U64 - 1, U64 - 2**12, 0])
def test_draws_at_the_edge(vocab, known, draw):
    """A row hash whose first number is the largest (or least) of all: no text is lost."""
    step = unmix((unmix(draw) - int(pieces._M)) % U64)
    row = unmix(unmix(step)) ^ int(mix64(np.zeros(1, np.uint64))[0])
    h = np.array([row], np.uint64)
    u = float(pieces.uniform(pieces.stream(h, 0, np.zeros(1, np.int64)), 0)[0])
    assert u == (draw >> 11) / 2.0**53
    for text in ("hello", "abcdefghijklmnopqrst", "漢"):
        ids, counts = pieces.encode_batch([text], h, vocab, pieces.SampleParams())
        assert counts[0] == len(ids) and 0 not in ids and pieces.decode_ids(ids.tolist(), vocab) == text


def test_ids_beyond_16_bits_and_sharp_alphas(vocab):
    assert all(ids.dtype == np.int32 for _, ids, _ in vocab.tables)
    for alpha in (0.0, 0.1, 30.0):
        text = "".join(random.Random(1).choices("abc漢 ", k=5000))
        ids, _ = pieces.encode_batch([text], np.zeros(1, np.uint64), vocab, pieces.SampleParams(alpha=alpha))
        assert pieces.decode_ids(ids.tolist(), vocab) == text
