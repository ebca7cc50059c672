"""The similarity join on families of texts, crowded keys, repeated ids and long texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import jaccard


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return set(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def groups(texts, k, percent):
    """Components over all pairs; texts by position."""
    sets, parent = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def family(n, r):
    """Texts of 100 words, each with one other word replaced: most pairs are just not similar enough."""
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(n):
        copy = list(base)
        copy[r.randrange(100)] = f"own{i}"
        out.append(" ".join(copy))
    return out


@pytest.fixture
def compared(monkeypatch):
    """Counts of the pairs that are verified."""
    counts, plain = [], jaccard.verified

    def counting(pairs, sets, percent, label):
        counts.append(pairs.count())
        return plain(pairs, sets, percent, label)

    monkeypatch.setattr(jaccard, "verified", counting)
    return counts


def test_a_family_is_compared_in_linear_time(spark, compared):
    pairs = {}
    for n in (300, 600):
        texts = family(n, random.Random(n))
        compared.clear()
        got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert got == dict(enumerate(groups(texts, 4, 85)))
        pairs[n] = sum(compared)
    assert pairs[600] < 2.6 * pairs[300] and pairs[600] < 600 * 599 / 8


def test_unlike_texts_with_a_common_passage(spark, compared):
    r = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([f"x{r.randrange(10**6)}" for _ in range(15)] + passage + [f"y{r.randrange(10**6)}" for _ in range(15)]) for _ in range(300)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)}
    assert sum(compared) < 300 * 20


def test_blocks_of_a_crowded_shingle(spark):
    r = random.Random(8)
    rows = [(t, i, 50, 0, r.choice([7] * 10 + [i])) for t, n in ((1, 100), (2, 9), (3, 40)) for i in range(n)]
    rows += [(4, i, 50, 0, 7) for i in range(30)]
    prefixes = spark.createDataFrame(rows, "token long, h long, n long, pos long, comp long").repartition(3)
    cells = jaccard.in_blocks(prefixes, 8)
    assert cells.groupBy("token", "cell").count().agg({"count": "max"}).first()[0] <= 40
    got = [(x.a, x.b) for x in jaccard.crossing_pairs(prefixes, 85, 8).collect()]
    want = {(min(a[1], b[1]), max(a[1], b[1])) for a in rows for b in rows if a[0] == b[0] and a[4] != b[4]}
    assert len(got) == len(set(got)) and set(got) == want


def test_rows_with_one_id(spark):
    long = " ".join(f"a{i}" for i in range(40))
    near = long + " tail"
    rows = [(1, long), (1, "quite another text that stands alone here"), (2, near), (2, near), (3, "quite another text that stands alone here"), (4, long), (5, None), (5, None), (None, near), (9, "a text of its own with some words"), (9, "a text of its own with some words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert got == [(1, 4, 1), (1, 37, 1), (2, 38, 1), (2, 38, 1), (3, 4, 1), (4, 37, 1), (5, 0, 5), (5, 0, 5), (9, 5, 9), (9, 5, 9)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(df).collect())
    assert kept == sorted([(1, long), (1, "quite another text that stands alone here"), (5, ""), (5, ""), (0, near), (9, "a text of its own with some words")])


@settings(max_examples=40, deadline=None)
@given(st.integers(300, 4000), st.floats(0, 0.08), st.integers(0, 10**6))
def test_large_sets_share_a_key_under_allocated_schemes(size, edits, seed):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
    y = x.copy()
    for i in rng.choice(len(y), int(edits * len(y)), replace=False):
        y[i] = rng.integers(0, 2**63)
    y = np.unique(y)
    both = len(np.intersect1d(x, y))
    if 100 * both < 85 * (len(x) + len(y) - both):
        return
    base = jaccard.default_scheme(jaccard.band_of(max(len(x), len(y)), 85), 85)
    common = x[: len(x) // 3]
    pilot = [np.unique(np.concatenate([common, rng.integers(0, 2**63, len(x) - len(common), dtype=np.uint64)])) for _ in range(6)]
    scheme = jaccard.allocate(base, pilot, 3000.0)
    assert sum(scheme.strength) == base.segments
    assert len(np.intersect1d(jaccard.signatures(x, scheme), jaccard.signatures(y, scheme)))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for size in (1, 5, 80, 3000, 100_000):
        x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for share in (0, 0.05, 0.5):
            y = np.unique(np.concatenate([x[int(share * len(x)) :], rng.integers(0, 2**63, int(share * len(x)), dtype=np.uint64)]))
            a, b = (np.frombuffer(jaccard.set_sketch(s), np.uint8).astype(int) for s in (x, y))
            assert np.abs(a - b).sum() <= len(np.setxor1d(x, y))


def test_allocation_uses_one_deletion_keys_in_large_bands():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    pilot = [np.unique(np.concatenate([common, rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(8)]
    base = jaccard.default_scheme(jaccard.band_of(1000, 85), 85)
    scheme = jaccard.allocate(base, pilot, 3000.0)
    assert base.segments > 64 and {0, 2} <= set(scheme.strength) and sum(scheme.strength) == base.segments


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 20)), max_size=60), st.integers(0, 99))
def test_absorbing_in_parts_keeps_every_set_in_sight(rows, seed):
    """Combining before and after the shuffle: sets that go on or stand in a pair cover all, sizes fit in pairs."""
    rng = np.random.default_rng(seed)
    size = rng.integers(80, 130, 21)
    sig, h = (np.array([x[i] for x in rows], np.int64) for i in (0, 1))
    on, more, pairs = jaccard.absorb(sig, h, size[h].astype(np.int32), np.zeros(len(h), bool), 85)
    seen = set(zip(sig[on].tolist(), h[on].tolist(), strict=True))
    assert (np.diff(on) > 0).all() and more.sum() <= len(pairs) * 5
    paired = {x for p in pairs.tolist() for x in p}
    assert {b for _, b in rows} <= {b for _, b in seen} | paired
    assert {a for a, _ in rows} == {a for a, _ in seen}
    assert all(100 * min(size[a], size[b]) >= 85 * max(size[a], size[b]) for a, b in pairs.tolist())
