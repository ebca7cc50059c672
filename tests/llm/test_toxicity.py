"""Toxicity: held-out figures, scores against plain code, unseen misspellings, edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from packetloom.llm import queries as Q
from packetloom.llm import toxicity as X

SF = "/root/testdata/sf0.1"


def test_held_out_figures(spark):
    toxic = dict(zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values(), strict=True))
    rows = Q.QUERIES["op13_toxicity"](spark, SF).collect()
    assert len(rows) == pq.read_metadata(f"{SF}/documents.parquet").num_rows
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    right = sum(p and y for _, p, y in held)
    assert right / sum(p for _, p, _ in held) > 0.85 and right / sum(y for _, _, y in held) > 0.8
    bad, good = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert np.mean([b > g for b in bad for g in good]) > 0.93


def sample(seed, n, insults):
    r = random.Random(seed)
    say = lambda: "".join(r.choice("bdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    texts, labels = [], []
    for i in range(n):
        words = [say() for _ in range(r.randint(20, 120))]
        if i % 3 == 0:
            for _ in range(1 + len(words) // 30):
                words[r.randrange(len(words))] = r.choice(insults)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_unseen_misspellings():
    model = X.train(*sample(1, 600, ["blockhead", "nitwit", "wretched"]))
    clean, _ = sample(2, 30, ["blockhead"])
    clean = [t for i, t in enumerate(clean) if i % 3]
    assert (model.scores(clean) < 0.5).all()
    for word in ("blockhaed", "bllockhead", "nitwitt", "wretchedd", "WRETCHED"):
        assert (model.scores([" ".join([*t.split()[:40], word, word]) for t in clean]) >= 0.5).mean() > 0.9, word


def test_scores_against_plain_code():
    texts, labels = sample(3, 120, ["blockhead"])
    model = X.train(texts, labels)
    odd = [*texts[:5], "", " \n", "x", "été_noir 漢字", "blockhead " * 5000, "y" * 50_000]
    for text, got in zip(odd, model.scores(odd), strict=True):
        top = bottom = 0.0
        for word, n in Counter(re.findall(r"[^\W_]+", text.lower())).items():
            raw = b"<" + word.encode() + b">"
            hashes = [zlib.crc32(raw)]
            for order in X.ORDERS:
                for i in range(len(raw) - order + 1):
                    h = (2166136261 + order) % 2**32
                    for b in raw[i : i + order]:
                        h = (h ^ b) * 16777619 % 2**32
                    hashes.append(h)
            mean = sum(float(model.table[(h ^ h >> 15) % len(model.table)]) for h in hashes) / len(hashes)
            top, bottom = top + math.sqrt(n) * mean, bottom + math.sqrt(n)
        want = 1 / (1 + math.exp(-(model.bias + (top / bottom if bottom else 0))))
        assert abs(got - want) < 1e-6
        assert abs(model.scores([text])[0] - got) < 1e-12


def test_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (4, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    model = X.fit(odd_docs, labels)
    rows = X.score(odd_docs, model).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[2] == by[3] == by[4] and [r.score for r in rows if r.doc_id == 8] == [by[8]] * 2
    assert X.score(no_docs, model).count() == 0
    for some, want in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0)):
        assert {round(r.score, 9) for r in X.score(odd_docs, X.fit(odd_docs, some)).collect()} == {want}
    assert {r.score for r in X.score(odd_docs, X.fit(no_docs, labels)).collect()} == {X.score(odd_docs, X.fit(no_docs, labels)).first().score}


def test_rates_of_drawing_shift_the_bias():
    texts, labels = sample(4, 300, ["blockhead"])
    even = X.train(texts, labels)
    rare = X.train(texts, labels, offset=3.0)
    assert rare.scores([""])[0] < even.scores([""])[0]
