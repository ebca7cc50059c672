"""An audit of how text filters interact: what each removes in every order of application, by part of the corpus.

A text's failures are one mask of a bit per filter. For every mask and every order of the filters a precomputed table
says at which step such a text goes (its first failing filter), or that it stays. Tasks look their rows' masks up and
count, with np.bincount, removals by part, label, order and step; the partial arrays of a part are then summed, first
within a salt, then over the salts. All figures of the report come from a part's summed array.

The filters (words are maximal runs of other than ASCII white space, case-sensitive):
A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 * code points; D holds one of
`#$%&*|`; E identical to the text of a row with a smaller id, in any part and whether that row is removed or not.

Texts meet for E as 128-bit digests: the smallest id of a digest is a combined minimum, and rows then look for their
own id and digest among these, so that a text of very many copies is never gathered.

Defined cases: a null text is empty (it fails A, and E behind a smaller id's empty text). A null part is the part of the
empty string. A row without an id has no smaller row and is none for others, and has no label. Rows with equal id and
equal text are all first. Of several labels of one id the largest counts for either label; null labels count as 0. An
empty table gives an empty report. Other columns are not read, whatever their names. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import bounded_batches, materialize, text_bytes

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
STEPS = len(FILTERS)
#: Labels of a document: bit 0 is good, bit 1 toxic.
LABELS = 4
CAPITALS = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: Partial arrays that a task holds before it hands them on: 23 KB each.
HELD_PARTS = 1000
SALTS = 16


def removal_table() -> np.ndarray:
    """For each mask (row) and order (column): the step, from 0, that removes such a text; STEPS if none does."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for mask in range(1 << STEPS):
        for o, order in enumerate(ORDERS):
            table[mask, o] = next((s for s, f in enumerate(order) if mask >> FILTERS.index(f) & 1), STEPS)
    return table


def text_failures(raw: bytes) -> int:
    """The mask of A to D for one text."""
    words = raw.split()
    n = len(words)
    points = len(raw.decode("utf-8"))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3


def failures(df: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask, digest) of every row; the mask is of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = text_bytes(batch.column(2))
            mask = pa.array([text_failures(x) for x in raw], pa.int32())
            digest = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(batch.column(1), ""), mask, digest], names=["id", "part", "mask", "digest"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(part_col).cast("string").alias("part"), F.col(text_col).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, "id long, part string, mask int, digest binary")


def with_repeats(rows: DataFrame) -> DataFrame:
    """rows (written out) with E in their masks. Rows without an id take no part."""
    known = rows.where("id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeated = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    marked = known.join(first, ["id", "digest"], "left").select("id", "part", F.col("mask").bitwiseOR(repeated).alias("mask"))
    return marked.unionByName(rows.where("id IS NULL").select("id", "part", "mask"))


def with_labels(rows: DataFrame, labels: DataFrame, id_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """(part, mask, label) of every row."""
    is_one = lambda c: F.max((F.col(c) == 1).cast("int"))
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic"))
    label = F.coalesce("good", F.lit(0)) + 2 * F.coalesce("toxic", F.lit(0))
    known = rows.where("id IS NOT NULL").join(of, "id", "left").select("part", "mask", label.alias("label"))
    return known.unionByName(rows.where("id IS NULL").select("part", "mask", F.lit(0).alias("label")))


def partial_counts(rows: DataFrame) -> DataFrame:
    """(part, salt, counts): arrays over label, order and step of the rows that each task has read."""
    schema = "part string, salt int, counts binary"
    table, orders = removal_table(), np.arange(len(ORDERS))
    cells = LABELS * len(ORDERS) * (STEPS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            names, part = parts.dictionary.to_pylist(), parts.indices.to_numpy()
            mask, label = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            # Parts are renumbered in a batch; HELD_PARTS at once keep the counted array small.
            for low in range(0, len(names), HELD_PARTS):
                of = (part >= low) & (part < low + HELD_PARTS)
                at = ((part[of] - low) * LABELS + label[of])[:, None] * len(ORDERS) + orders
                counts = np.bincount((at * (STEPS + 1) + table[mask[of]]).ravel(), minlength=cells * min(HELD_PARTS, len(names) - low))
                for name, c in zip(names[low : low + HELD_PARTS], counts.reshape(-1, cells), strict=True):
                    held[name] = held[name] + c if name in held else c
                if len(held) >= HELD_PARTS:
                    yield _packed(held, salt)
                    held = {}
        if held:
            yield _packed(held, salt)

    return bounded_batches(rows).mapInArrow(run, schema)


def _packed(held: dict[str, np.ndarray], salt: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array([c.astype("<i8").tobytes() for c in held.values()], pa.binary())], names=["part", "salt", "counts"])


def summed(partials: DataFrame, keys: list[str]) -> DataFrame:
    """The arrays of equal keys added up while they stream by in the keys' order: a task holds one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for name, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (name, salt if "salt" in keys else 0)
                if key != now and now is not None:
                    yield _packed({now[0]: total}, now[1])
                counts = np.frombuffer(raw, "<i8")
                now, total = key, counts if key != now else total + counts
        if now is not None:
            yield _packed({now[0]: total}, now[1])

    return bounded_batches(partials.repartition(*keys).sortWithinPartitions(*keys)).mapInArrow(run, partials.schema)


def report(totals: DataFrame) -> DataFrame:
    """The figures of every order and step from each part's summed array."""
    schema = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    where = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    place = np.argsort(where, axis=1)  # of each filter in each order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        of_order, of_step = np.repeat(np.arange(len(ORDERS)), STEPS), np.tile(np.arange(STEPS), len(ORDERS))
        of_filter = where[of_order, of_step]
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_label = np.frombuffer(raw, "<i8").reshape(LABELS, len(ORDERS), STEPS + 1)
                gone, good, toxic = by_label.sum(0), by_label[[1, 3]].sum(0), by_label[[2, 3]].sum(0)
                kept = gone[0].sum() - np.cumsum(gone[:, :STEPS], axis=1)
                by_filter = np.take_along_axis(gone, place, axis=1)  # removed by each filter, order by order
                # A filter that comes first removes all its failures; one that comes last, what fails it alone.
                failing = np.array([by_filter[place[:, f] == 0, f][0] for f in range(STEPS)])
                alone = np.array([by_filter[place[:, f] == STEPS - 1, f][0] for f in range(STEPS)])
                removed = gone[of_order, of_step]
                figures = [kept[of_order, of_step], removed, failing[of_filter] - removed, alone[of_filter], good[of_order, of_step], toxic[of_order, of_step], by_filter.sum(0)[of_filter]]
                arrays = [pa.array([part] * len(removed), pa.string()), pa.array([ORDERS[o] for o in of_order], pa.string()), pa.array(of_step + 1, pa.int32()), pa.array([FILTERS[f] for f in of_filter], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in figures)], names=names)

    return totals.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Per part, order and step: what is kept after it, removed by it, and why (see the head of this module)."""
    rows = with_repeats(materialize(failures(docs, id_col, text_col, part_col), "failures"))
    partials = partial_counts(with_labels(rows, labels, id_col, good_col, toxic_col))
    return report(summed(summed(partials, ["part", "salt"]), ["part"]))
