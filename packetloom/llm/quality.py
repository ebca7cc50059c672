"""Quality rules as a short-circuit cascade.

Each rule is a cheap test on one text. A bounded sample gives every rule's mean cost and how often it
rejects; rules then run by rejections per second, highest first, and a text leaves at its first failed
rule. The order changes only the work and the name of the failed rule, never which texts are kept.

Defined cases: a null text has no words and fails `few_words`; so does an empty one. Very long texts are
read whole. Repeated rows are judged alike. An empty table gives an empty result. Other columns pass
through `quality_cascade` untouched; its own result columns replace columns of the same name.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, text_bytes

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
WINDOW = 5
#: Texts that the cost estimate looks at.
SAMPLE_ROWS = 200


class TextFeatures:
    """Features of one text, each computed when a rule first asks for it."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, WHITE).decode("utf-8"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        n = len(w) - WINDOW + 1
        if n < 2:
            return 0
        windows = list(zip(*(w[i : i + n] for i in range(WINDOW)), strict=True))
        if len(set(windows)) == n:
            return 0
        seen = Counter(windows)
        marks = np.zeros(len(w) + 1, np.int32)
        at = np.fromiter((i for i, x in enumerate(windows) if seen[x] > 1), np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + WINDOW, -1)
        return int((np.cumsum(marks)[:-1] > 0).sum())

    @cached_property
    def n_stutters(self) -> int:
        w = self.words
        return sum(map(bytes.__eq__, w, w[1:]))

    @cached_property
    def n_letters(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, LETTERS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[TextFeatures], bool]


BASE_RULES = (
    Rule("few_words", lambda f: f.n_words < 10),
    Rule("repeated_windows", lambda f: 100 * f.n_repeat_words > 20 * f.n_words),
)
OWN_RULES = (
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("word_length", lambda f: f.word_chars < 2 * f.n_words or f.word_chars > 20 * f.n_words),
    Rule("stutter", lambda f: 10 * f.n_stutters > 3 * f.n_words),
    Rule("capitals", lambda f: f.n_letters >= 40 and 5 * f.n_upper > 4 * f.n_letters),
)
RULES = BASE_RULES + OWN_RULES


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    seconds: float
    rejection: float


def estimate(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[RuleEstimate]:
    """Mean seconds a text and share of rejected texts of each rule, each on features of its own."""
    out = []
    for rule in rules:
        began = time.perf_counter()
        rejected = sum(rule.rejects(TextFeatures(x)) for x in texts)
        took = time.perf_counter() - began
        out.append(RuleEstimate(rule.name, took / max(1, len(texts)), rejected / max(1, len(texts))))
    return out


def order_rules(estimates: list[RuleEstimate], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Most rejections per second first; of rules that reject nothing in the sample the cheapest first."""
    by_name = {e.name: e for e in estimates}

    def rank(rule: Rule) -> tuple[float, float]:
        e = by_name[rule.name]
        return (-e.rejection / max(e.seconds, 1e-9), e.seconds)

    return tuple(sorted(rules, key=rank))


def plan_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Order the rules on sample_rows texts at most; only the order depends on the sample."""
    taken = df.select(F.coalesce(F.col(text_col), F.lit(""))).limit(sample_rows).collect()
    return order_rules(estimate([r[0].encode() for r in taken], rules), rules)


RESULT = T.StructType(
    [
        T.StructField("kept", T.BooleanType()),
        T.StructField("failed_rule", T.StringType()),
        T.StructField("rules_run", T.IntegerType()),
    ]
)
BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(features: TextFeatures, ordered: tuple[Rule, ...]) -> tuple[bool, str | None, int]:
    for i, rule in enumerate(ordered):
        if rule.rejects(features):
            return False, rule.name, i + 1
    return True, None, len(ordered)


def quality_cascade(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, with_counts: bool = False) -> DataFrame:
    """df with kept, failed_rule (the first that failed) and rules_run; with_counts adds the base counts of
    every text, which then are computed whether or not an earlier rule failed."""
    ordered = [r.name for r in plan_cascade(df, text_col, rules)]
    # Rules hold plain functions of this module; tasks look them up by name.
    extra = [T.StructField(c, T.LongType()) for c in BASE_COLUMNS] if with_counts else []
    made = {f.name for f in [*RESULT, *extra]}
    base = df.select(*[c for c in df.columns if c not in made])
    schema = T.StructType([*base.schema.fields, *RESULT.fields, *extra])
    own = {r.name: r for r in rules} if rules is not RULES else None

    def run(batches):
        known = own or {r.name: r for r in RULES}
        line = tuple(known[n] for n in ordered)
        for batch in batches:
            raw = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
            rows, counts = [], []
            for x in raw:
                f = TextFeatures(x)
                rows.append(judge(f, line))
                if with_counts:
                    counts.append(tuple(getattr(f, c) for c in BASE_COLUMNS))
            kept, failed, ran = zip(*rows, strict=True) if rows else ((), (), ())
            arrays = [*batch.columns, pa.array(kept, pa.bool_()), pa.array(failed, pa.string()), pa.array(ran, pa.int32())]
            if with_counts:
                arrays += [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE_COLUMNS))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return bounded_batches(base).mapInArrow(run, schema)
