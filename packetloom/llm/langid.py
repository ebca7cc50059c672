"""Language identification by averaged hashed subword embeddings and a linear softmax.

Byte n-grams inside words are hashed into buckets; a text is the mean of its buckets' embeddings; a linear
softmax on that mean gives the language. Both layers are trained by stochastic gradient descent in numpy on
a bounded sample of labelled rows (`per_language` of each language). The softmax has one class more, for what is in
none of the languages; it learns from the sample's words with their letters shuffled and from words in random
scripts, and takes its share of the probability. A held-back part of the sample calibrates:
its texts, whole and cut to a few words, set a temperature and how fast certainty grows with a text's length;
its texts whole, cut, and joined in pairs of two languages (which are not to be rejected for that), against the
same words with their letters shuffled, set the score below which a prediction is rejected.

Defined cases: null text or text without a letter gives `und` with score 0 and is rejected. Texts are read
whole. Null languages are never learned from. Ties between languages go to the first in sorted order.
Repeated rows get equal results; an empty table gives an empty result; with no labelled row at all every
prediction is `und`. Other columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, chunks, text_bytes

UNKNOWN = "und"
ORDERS = (2, 3, 4)
PAD = max(ORDERS)


@dataclass(frozen=True)
class LangIdParams:
    buckets: int = 1 << 16
    dim: int = 16
    per_language: int = 600
    epochs: int = 6
    rate: float = 0.5
    calibration_share: float = 0.2
    #: Share of right calibration answers that the rejection threshold may turn away.
    rejected_share: float = 0.001
    #: Held-back texts are also cut to so many words, from a drawn place, to learn what short texts are worth.
    snippets: tuple[int, ...] = (1, 2, 4, 8, 16)
    #: Snippets of so many words or more have to be accepted like whole texts.
    sure_words: int = 8
    seed: int = 11


#: Letters and bytes of multi-byte characters stay; A-Z becomes a-z; everything else becomes a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def bucket_stream(texts: list[bytes], buckets: int):
    """For each n-gram order: the bucket of every n-gram with no inner space, where it starts, and where each text's
    stretch ends. A text stands between one space and PAD spaces, so that no n-gram reaches into the next text."""
    sizes = np.array([len(x) + 1 + PAD for x in texts])
    data = _FOLD[np.frombuffer(b"".join(b" " + x + b" " * PAD for x in texts), np.uint8)]
    wide = data.astype(np.uint32)
    owner_ends = np.cumsum(sizes)
    space = data == 32
    tail = np.zeros(len(data), bool)
    for k in range(1, PAD + 1):
        tail[owner_ends - k] = True
    n = len(data)
    for order in ORDERS:
        h = np.full(n - order + 1, 2166136261 + order, np.uint32)
        inner = np.zeros(n - order + 1, bool)
        for k in range(order):
            part = wide[k : n - order + 1 + k]
            h = (h ^ part) * np.uint32(16777619)
            if 0 < k < order - 1:
                inner |= space[k : n - order + 1 + k]
        edge = space[: n - order + 1] & space[order - 1 :]
        ok = np.flatnonzero(~(inner | edge | tail[: n - order + 1]))
        h = h[ok]
        h ^= h >> np.uint32(15)
        yield (h % np.uint32(buckets)).astype(np.int64), ok, owner_ends


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LangModel:
    langs: list[str]
    #: Class scores of every bucket: the embeddings times the linear layer. The last class is none of the languages.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: N-grams at which a text is worth half of a long one.
    half: float = 0.0
    #: Probability spread over all classes, from the size of the calibration sample: no sample is proof.
    doubt: float = 0.0
    threshold: float = 0.0
    info: dict = field(default_factory=dict)

    def mean_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Class scores of each text, and the number of its n-grams."""
        out = np.zeros((len(texts), len(self.langs) + 1), np.float64)
        grams = np.zeros(len(texts))
        for part in chunks([len(x) for x in texts], 1 << 18):
            some = texts[part]
            total = np.zeros((len(some), out.shape[1]), np.float64)
            count = np.zeros(len(some), np.float64)
            for ids, at, ends in bucket_stream(some, len(self.table)):
                if not len(ids):
                    continue
                cuts = np.searchsorted(at, np.concatenate([[0], ends[:-1]]))
                seen = np.diff(np.append(cuts, len(at)))
                full = seen > 0
                total[full] += np.add.reduceat(self.table[ids], cuts[full], axis=0, dtype=np.float64)
                count += seen
            out[part] = total / np.maximum(count, 1)[:, None]
            grams[part] = count
        return out + self.bias, grams

    def probabilities(self, scores: np.ndarray, grams: np.ndarray) -> np.ndarray:
        worth = grams / (grams + self.half) if self.half else np.ones(len(grams))
        return (1 - self.doubt) * _softmax(scores * worth[:, None] / self.temperature) + self.doubt / scores.shape[1]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The most probable language of each text, and its probability."""
        p = self.probabilities(*self.mean_scores(texts))[:, :-1]
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def has_letter(raw: bytes) -> bool:
    if raw.translate(None, _ASCII_LETTERS) != raw:
        return True
    return any(c.isalpha() for c in raw.decode("utf-8")) if not raw.isascii() else False


_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def two_languages(y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Pairs of the given rows: each row with a drawn row of every other language."""
    of = {lang: rows[y[rows] == lang] for lang in np.unique(y[rows])}
    return [(int(i), int(rng.choice(of[lang]))) for i in rows for lang in of if lang != y[i]]


def train(texts: list[bytes], labels: list[str], params: LangIdParams = LangIdParams()) -> LangModel | None:
    """Fit embeddings and softmax on the given rows; None if there is no language to learn."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(params.seed)
    y = np.array([langs.index(x) for x in labels])
    held = rng.random(len(texts)) < params.calibration_share
    rows = np.flatnonzero(~held) if (~held).any() else np.arange(len(texts))
    check = np.flatnonzero(held) if held.any() else rows
    noise = [no_language(snippet(texts[i], int(rng.integers(1, 200)), rng), rng) for i in rng.choice(rows, max(1, len(rows) // len(langs)))]
    fit = np.concatenate([rows, len(texts) + np.arange(len(noise))])
    truth = np.concatenate([y, np.full(len(noise), len(langs))])
    bags = []
    for x in [*texts, *noise]:
        ids = np.concatenate([b for b, _, _ in bucket_stream([x], params.buckets)])
        u, c = np.unique(ids, return_counts=True)
        bags.append((u, (c / max(1, c.sum())).astype(np.float32)))
    e = rng.normal(0, 0.3, (params.buckets, params.dim)).astype(np.float32)
    w = np.zeros((params.dim, len(langs) + 1), np.float32)
    bias = np.zeros(len(langs) + 1, np.float32)
    weight = len(fit) / np.maximum(1, np.bincount(truth[fit], minlength=len(bias))) / len(bias)
    steps, total = 0, params.epochs * len(fit)
    for _ in range(params.epochs):
        for i in rng.permutation(fit):
            u, c = bags[i]
            rate = params.rate * (1 - steps / total)
            steps += 1
            if not len(u):
                continue
            v = c @ e[u]
            g = _softmax(v @ w + bias)
            g[truth[i]] -= 1
            g *= weight[truth[i]]
            back = w @ g
            w -= rate * np.outer(v, g)
            bias -= rate * 0.1 * g
            e[u] -= (rate * 50) * np.outer(c, back)
    model = LangModel(langs, e @ w, bias.astype(np.float64))
    calibrate(model, [texts[i] for i in check], y[check], params, rng)
    model.info["trained_rows"] = int(len(rows))
    return model


def snippet(text: bytes, words: int, rng: np.random.Generator) -> bytes:
    """So many words of a text, from a drawn place."""
    w = text.split()
    at = int(rng.integers(0, max(1, len(w) - words + 1)))
    return b" ".join(w[at : at + words])


def shuffled(text: bytes, rng: np.random.Generator) -> bytes:
    """A text whose words keep their letters and lose their order: no language."""
    return " ".join("".join(rng.permutation(list(w))) for w in text.decode("utf-8", "replace").split()).encode()


def no_language(text: bytes, rng: np.random.Generator) -> bytes:
    """A text's words with their letters shuffled or, in one case of three, moved to one other script."""
    if rng.random() < 2 / 3:
        return shuffled(text, rng)
    low, size = _SCRIPTS[int(rng.integers(len(_SCRIPTS)))]
    return " ".join("".join(chr(low + x) for x in rng.integers(0, size, max(1, len(w)))) for w in text.split()).encode()


#: First code point and size of stretches of letters (Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul).
_SCRIPTS = ((97, 26), (0x3B1, 25), (0x430, 32), (0x5D0, 27), (0x627, 36), (0x905, 53), (0xE01, 46), (0x3041, 86), (0x4E00, 20_000), (0xAC00, 11_000))


def calibrate(model: LangModel, texts: list[bytes], truth: np.ndarray, params: LangIdParams, rng: np.random.Generator) -> None:
    """Set temperature, half, doubt and threshold from held-back texts (see the head of this module)."""
    cut = [(snippet(t, n, rng), y, n) for n in params.snippets for t, y in zip(texts, truth.tolist(), strict=True)]
    cut = [c for c in cut if has_letter(c[0])]
    noise = [no_language(c, rng) for c in [*texts, *(c for c, _, _ in cut)]]
    known = np.concatenate([truth, np.array([y for _, y, _ in cut], np.int64), np.full(len(noise), len(model.langs))])
    scores, grams = model.mean_scores([*texts, *(c for c, _, _ in cut), *noise])
    model.doubt = 1 / (len(truth) + 2)

    def loss(setting: tuple[float, float]) -> float:
        model.temperature, model.half = setting
        p = model.probabilities(scores, grams)[np.arange(len(known)), known]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    model.temperature, model.half = min(((t, h) for t in np.geomspace(0.1, 10, 31) for h in (0.0, *np.geomspace(1, 512, 19))), key=loss)
    p = model.probabilities(scores, grams)[:, :-1]
    right = p.argmax(1) == known
    long = np.array([True] * len(truth) + [n >= params.sure_words for _, _, n in cut])
    long = np.concatenate([long, long & np.array([len(c.split()) >= params.sure_words for c in noise], bool)])
    mixed = two_languages(truth, np.arange(len(truth)), rng)
    both = model.probabilities(*model.mean_scores([texts[i] + b" " + texts[j] for i, j in mixed]))[:, :-1]
    fits = np.array([b in (truth[i], truth[j]) for b, (i, j) in zip(both.argmax(1), mixed, strict=True)], bool)
    sure = np.sort(np.concatenate([p.max(1)[right & long], both.max(1)[fits]]))
    off = p.max(1)[(known == len(model.langs)) & long]
    high = float(np.quantile(off, 0.999)) if len(off) else 1.0
    model.threshold = float(sure[int(len(sure) * params.rejected_share)]) if len(sure) else 0.0
    if high < model.threshold:
        model.threshold = (high + model.threshold) / 2  # noise and texts are apart: half-way between them
    model.info = {
        "accuracy": float(right[: len(truth)].mean()) if len(truth) else 0.0, "calibration_rows": int(len(truth)), "calibration_pairs": len(mixed), "calibration_snippets": len(cut),
        "noise_rejected": float((off < model.threshold).mean()) if len(off) else 0.0, "noise_high": high,
    }


def labelled_sample(df: DataFrame, text_col: str, lang_col: str, key: Column, params: LangIdParams) -> tuple[list[bytes], list[str]]:
    """About per_language rows of each language, chosen by a hash of the row key, so that reruns agree."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, params.per_language / n))).otherwise(share)
    drawn = F.pmod(F.xxhash64(key, F.lit(params.seed)), F.lit(1_000_000)) < share * 1_000_000
    taken = rows.where(drawn).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.xxhash64(key).alias("k")).collect()
    taken.sort(key=lambda r: (r.k, r.l, r.t))
    return [r.t.encode() for r in taken], [r.l for r in taken]


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key: Column | None = None, params: LangIdParams = LangIdParams()) -> LangModel | None:
    texts, labels = labelled_sample(df, text_col, lang_col, F.col("doc_id") if key is None else key, params)
    return train(texts, labels, params)


def identify(df: DataFrame, model: LangModel | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (0 to 1, calibrated) and accepted (score reaches the threshold)."""
    made = ("lang_pred", "score", "accepted")
    base = df.select(*[c for c in df.columns if c not in made])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            raw = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            letters = np.fromiter((has_letter(x) for x in raw), bool, len(raw))
            if m is None or not len(raw):
                names, score, ok = [UNKNOWN] * len(raw), np.zeros(len(raw)), np.zeros(len(raw), bool)
            else:
                best, p = m.predict(raw)
                names = [m.langs[b] if known else UNKNOWN for b, known in zip(best, letters, strict=True)]
                score = np.where(letters, np.clip(p, 0, 1), 0.0)
                ok = letters & (score >= m.threshold)
            arrays = [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return bounded_batches(base).mapInArrow(run, schema)
