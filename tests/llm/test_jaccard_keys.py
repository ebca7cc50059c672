"""Index keys of the similarity join: made for many sets at once, the same as for each set alone."""

import random

import numpy as np
import pyarrow as pa

from packetloom.llm import jaccard


class Captured:
    """Stands for a table: keeps the function that mapInArrow() would run in tasks."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_keys_are_made_for_many_sets_at_once(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 90))) for _ in range(1_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_000), pa.int64()), pa.array(texts)], names=["id", "text"])
    calls, plain = [], jaccard.segment_of
    monkeypatch.setattr(jaccard, "segment_of", lambda x, scheme: calls.append(len(x)) or plain(x, scheme))
    rows = [n for b in jaccard.index_keys(Captured(), 85, 4, {})(iter([batch])) for n in b.column(2).to_pylist()]
    assert len(rows) > 20_000 and all(rows)
    assert len(calls) < 50


def test_keys_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 5, 9, 40, 41, 43, 300, 310, 2_000, 2_010, 300)]
    for scheme in ({}, {jaccard.band_of(300, 85): jaccard.allocate(jaccard.default_scheme(jaccard.band_of(300, 85), 85), [np.unique(np.concatenate([sets[4], s[:260]])) for s in (sets[7], sets[8], sets[11])], 3e6)}):
        keys, whose = jaccard.all_signatures(sets, 85, dict(scheme))
        assert (np.diff(whose) >= 0).all()
        for i, x in enumerate(sets):
            band = jaccard.band_of(len(x), 85)
            known = [scheme.get(b) or jaccard.default_scheme(b, 85) for b in (band, band + 1)]
            own = [jaccard.signatures(x, s) for s in known if s]
            assert sorted(keys[whose == i].tolist()) == sorted(np.concatenate(own).tolist() if own else [])


def test_pairs_met_in_a_task_come_back(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[:i], f"own{i}", *words[i + 1 :]]) for i in range(0, 200, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    names = {jaccard._id64(jaccard.set_key(x)) for x in jaccard.shingle_sets([t.encode() for t in texts], 4)}
    got = jaccard.meet(jaccard.index_keys(docs, 85, 4, {}), 85).collect()
    assert {r.a for r in got} | {r.b for r in got if r.b is not None} == names


def test_word_hashes_are_sums_of_bytes_by_place():
    texts = [b"", b" ", b"a", b" a  b", b"a\x0bb\tc\x0cd\r\ne f", b"", b"x" * 300_000 + b" y z", "é ü".encode(), b"a\x00b \x1f c"]
    h, cuts = jaccard.word_hashes(texts)
    power = [pow(jaccard._ODD, i, 2**64) for i in range(10)]
    for text, lo, hi in zip(texts, cuts[:-1], cuts[1:], strict=True):
        words = text.split()
        assert hi - lo == len(words)
        for word, got in zip(words, h[lo:hi], strict=True):
            if len(word) < 10:
                want = sum(int(jaccard._BYTE[c]) * p for c, p in zip(word, power, strict=False)) + len(word)
                assert jaccard.mix64(np.array([want % 2**64], np.uint64))[0] == got
