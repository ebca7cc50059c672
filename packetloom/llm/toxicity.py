"""Toxicity by subword bags: averaged n-gram embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (with its edges) and of itself; a text is the mean of its
distinct words, weighted by the square root of their counts, so that a line repeated a thousand times weighs little.
A linear softmax on that mean gives the probability of the label. As n-grams are shared, a misspelling or an inflection
that no labelled text holds is near the words it comes from.

Embeddings and softmax are trained together by stochastic gradient descent on a bounded sample of labelled rows
(`per_label` of either label, drawn by a hash of the id). Where the labels are drawn at different rates, their ratio is
an offset of the logits, so that probabilities hold for all rows. Insults are one word in a hundred, and a text has more
n-grams than the sample has texts: only n-grams whose mean weight differs between the labels by `distinct` standard
errors get a vector; all others are zero vectors that count in the means.

Defined cases: a null text is empty, and an empty text or one without a letter or digit gets the score of the bias
alone. Texts are scored whole, and each by itself. Null labels and ids are never learned from, nor texts over
`most_bytes`; of several labels of one id the largest counts. Without rows of both labels every score is 1 if
there are rows of label 1, else 0. Repeated rows are scored alike; an empty table gives an empty result. Other columns pass
through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, chunks, small

WORD = re.compile(r"[^\W_]+")
ORDERS = (3, 4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    buckets: int = 1 << 18
    dim: int = 8
    epochs: int = 30
    rate: float = 0.3
    #: Standard errors between the labels' means from which an n-gram gets a vector, and texts that must hold it.
    distinct: float = 4.0
    least_texts: int = 3
    per_label: tuple[int, int] = (6000, 3000)
    most_bytes: int = 200_000
    seed: int = 5


def word_counts(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams one after the other, word by word, and how many each word has."""
    raw = [b"<" + w.encode() + b">" for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(raw)), sizes)
    found, owner = [], []
    for order in ORDERS:
        n = len(data) - order + 1
        if n <= 0:
            continue
        h = np.full(n, 2166136261 + order, np.uint32)
        for k in range(order):
            h = (h ^ data[k : k + n]) * np.uint32(16777619)
        inside = np.flatnonzero(np.arange(n) + order <= ends[word[:n]])
        found.append(h[inside])
        owner.append(word[inside])
    whole = np.fromiter((zlib.crc32(x) for x in raw), np.uint32, len(raw))
    h, owner = np.concatenate([*found, whole]), np.concatenate([*owner, np.arange(len(raw))])
    h ^= h >> np.uint32(15)
    order = np.argsort(owner, kind="stable")
    return (h[order] % np.uint32(buckets)).astype(np.int32), np.bincount(owner, minlength=len(raw))


def word_means(values: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean over each word's n-grams of their values; every word has one at least."""
    if not len(counts):
        return np.zeros(0)
    return np.add.reduceat(values[ids], np.cumsum(counts) - counts, dtype=np.float64) / counts


@dataclass
class ToxicityModel:
    #: Difference of the two class scores of every bucket: the embeddings times the linear layer.
    table: np.ndarray
    bias: float
    vectors: int = 0

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability of label 1 for each text."""
        out = np.zeros(len(texts))
        known: dict[str, float] = {}
        for part in chunks([len(x) for x in texts]):
            bags = [word_counts(x) for x in texts[part]]
            new = list({w for bag in bags for w in bag if w not in known})
            if new:
                known.update(zip(new, word_means(self.table, *subwords(new, len(self.table))).tolist(), strict=True))
            for i, bag in enumerate(bags, part.start):
                weight = np.sqrt(np.fromiter(bag.values(), float, len(bag)))
                out[i] = weight @ np.fromiter((known[w] for w in bag), float, len(bag)) / weight.sum() if bag else 0.0
            if len(known) > 200_000:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -500, 500)))


def bags_of(texts: list[str], buckets: int):
    """Each text's buckets and their weights in its mean."""
    for part in chunks([len(x) for x in texts]):
        counts = [word_counts(x) for x in texts[part]]
        words = {w: i for i, w in enumerate({w for bag in counts for w in bag})}
        ids, sizes = subwords(list(words), buckets) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        ends = np.cumsum(sizes)
        for bag in counts:
            if not bag:
                yield np.zeros(0, np.int64), np.zeros(0, np.float32)
                continue
            at = [words[w] for w in bag]
            weight = np.sqrt(np.fromiter(bag.values(), float, len(bag)))
            each = np.repeat(weight / weight.sum() / sizes[at], sizes[at])
            u, back = np.unique(np.concatenate([ids[ends[i] - sizes[i] : ends[i]] for i in at]), return_inverse=True)
            yield u, np.bincount(back, each).astype(np.float32)


def distinct_buckets(texts: list[str], y: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Marks of the buckets whose mean weights differ between the labels."""
    sums, squares, seen = np.zeros((2, params.buckets)), np.zeros(params.buckets), np.zeros(params.buckets, int)
    for label, (u, a) in zip(y.tolist(), bags_of(texts, params.buckets), strict=True):
        sums[label][u] += a
        squares[u] += a.astype(float) ** 2
        seen[u] += 1
    n1 = int(y.sum())
    n0 = len(y) - n1
    variance = squares / len(y) - (sums.sum(axis=0) / len(y)) ** 2
    errors = np.abs(sums[1] / n1 - sums[0] / n0) / np.sqrt(np.maximum(variance, 1e-16) * (1 / n1 + 1 / n0))
    return (seen >= params.least_texts) & (errors >= params.distinct)


def train(texts: list[str], labels: list[int], offset: float = 0.0, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit embeddings and softmax. offset is the logarithm of the rate at which label 1 was drawn over that of label 0."""
    y = np.array(labels, np.int64)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(np.zeros(params.buckets, np.float32), 500.0 if y.any() else -500.0)
    rng = np.random.default_rng(params.seed)
    has = distinct_buckets(texts, y, params)
    bags = [(u[has[u]], a[has[u]]) for u, a in bags_of(texts, params.buckets)]
    e = rng.normal(0, 0.1, (params.buckets, params.dim)).astype(np.float32) * has[:, None]
    w = rng.normal(0, 0.1, (params.dim, 2)).astype(np.float32)
    bias, prior = np.zeros(2), np.array([0.0, offset])
    seen_e, seen_w, seen_b = np.full(params.buckets, 1e-8, np.float32), np.full(w.shape, 1e-8), np.full(2, 1e-8)
    for _ in range(params.epochs):
        for i in rng.permutation(len(y)):
            u, a = bags[i]
            v = a @ e[u]
            z = v @ w + bias + prior
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            to_text, to_w = w @ g, np.outer(v, g)
            # Steps shrink with the squares seen so far, for each vector by itself.
            seen_w += to_w * to_w
            w -= params.rate * to_w / np.sqrt(seen_w)
            seen_b += g * g
            bias -= params.rate * g / np.sqrt(seen_b)
            to_e = np.outer(a, to_text)
            seen_e[u] += (to_e * to_e).mean(axis=1)
            e[u] -= params.rate * to_e / np.sqrt(seen_e[u])[:, None]
    return ToxicityModel(e @ (w[:, 1] - w[:, 0]), float(bias[1] - bias[0]), int(has.sum()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Train on a sample of the labelled docs: labels are drawn first, by a hash of their id, and only their texts are read out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    known = docs.select(id_col).where(F.col(id_col).isNotNull()).join(known, id_col)
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    rate = {y: min(1.0, params.per_label[y] / n) for y, n in sizes.items()}
    share = F.when(F.col("y") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0))
    drawn = known.distinct().where(F.pmod(F.xxhash64(id_col, F.lit(params.seed)), F.lit(1_000_000)) < share * 1_000_000)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = docs.select(id_col, text.alias("t")).where(F.octet_length("t") <= params.most_bytes)
    rows = chosen.join(small(drawn, sum(params.per_label)), id_col).select(F.xxhash64(id_col).alias("k"), "y", "t").collect()
    rows.sort()
    return train([r.t for r in rows], [r.y for r in rows], float(np.log(rate.get(1, 1.0) / rate.get(0, 1.0))), params)


def score(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """df with score (the probability of label 1) and predicted (1 from 0.5)."""
    made = ("score", "predicted")
    base = df.select(*[c for c in df.columns if c not in made])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = df.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index(text_col)

    def run(batches):
        for batch in batches:
            p = sent.value.scores([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return bounded_batches(base).mapInArrow(run, schema)
