"""Concatenate-and-cut packing of token streams into fixed windows.

Pass one tokenizes every text once, appends the end token and writes the ids with each document's place in
its partition. The partitions' token totals, summed up, give every partition's global offset. Pass two cuts
the global stream at multiples of `length`; a document that crosses a cut leaves one boundary record (piece)
on either side. Only the very last sequence can be short. No row is shuffled.

Tokenizing uses the ranks in a byte-level BPE `tokenizer.json` through tiktoken's engine, which gives the ids
of the `tokenizers` library (tests hold them together) at about four times its speed. As there, the string of a
special token inside a text is that token; `special_as_text` makes it ordinary text.

Defined cases: a null text counts as empty, and an empty text is its end token alone. Repeated rows are packed
each for itself. An empty table gives no pieces. Very long texts span many sequences, very long runs of white
space included, which the library tokenizes. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import bounded_batches, materialize, small

#: The printable stand-ins that byte-level BPE files use for bytes are the bytes 33-126,
#: 161-172 and 174-255 themselves; all others are numbered from code point 256 in byte order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Fixed value: the pre-tokenization pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the faster engine isn't given.
LONG_SPACE = re.compile(r"\s{10000}")


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """The encoder of a byte-level BPE tokenizer.json; one per worker process."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    rest = (b for b in range(256) if b not in _PLAIN)
    byte_of = {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library_bpe(path: str, special_as_text: bool):
    """The same tokenizer.json in the `tokenizers` library; one per worker process."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


def encoder(path: str, special_as_text: bool = False) -> Callable[[str], list[int]]:
    """A function from a text to its ids. The faster engine's pattern steps back over a run of white space and fails on
    very long ones: texts with such a run, and any other that it refuses, go to the library."""
    fast = byte_bpe(path)
    fast = fast.encode_ordinary if special_as_text else partial(fast.encode, allowed_special="all")

    def encode(text: str) -> list[int]:
        if not LONG_SPACE.search(text):
            try:
                return fast(text)
            except ValueError:
                pass
        return library_bpe(path, special_as_text).encode(text, add_special_tokens=False).ids

    return encode


def tokenize(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """One row per document: its ids (little-endian uint32), their number, the partition and the place in it."""
    key = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, key), T.StructField("doc_tokens", T.LongType()), T.StructField("part", T.LongType()), T.StructField("part_start", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, special_as_text)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                piece = batch.slice(low, 256)
                ids = [np.array([*encode(t or ""), end_id], "<u4") for t in piece.column(1).to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes), pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=schema.names,
                )

    return bounded_batches(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def pack(tokens: DataFrame, id_col: str = "doc_id", length: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pieces of the windows over tokenize()'s rows, which must be materialized (their places are read twice)."""
    totals = tokens.groupBy("part").agg(F.max(F.col("part_start") + F.col("doc_tokens")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the input: a count of tasks, not of documents.
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = tokens.select("part").distinct().count()
    placed = tokens.join(small(offsets, parts), "part").select(id_col, "doc_tokens", (F.col("base") + F.col("part_start")).alias("at"), "ids")
    fields = [
        T.StructField(id_col, tokens.schema[id_col].dataType),
        *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ]
    schema = T.StructType([*fields, *([T.StructField("ids", T.BinaryType())] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            at = batch.column(2).to_numpy()
            raw = batch.column(3).to_pylist()
            counts = (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), counts)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            seq = at[doc] // length + nth
            low = np.maximum(at[doc], seq * length)
            high = np.minimum(at[doc] + n[doc], (seq + 1) * length)
            start, size = low - at[doc], high - low
            views = [memoryview(raw[d])[4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            crc = np.fromiter((zlib.crc32(v) for v in views), np.int64, len(views))
            arrays = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, size, crc, n[doc], seq, low - seq * length))]
            if keep_ids:
                arrays.append(pa.array([v.tobytes() for v in views], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return bounded_batches(placed).mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Tokenize, then cut. The token table is written to the shared folder between the two passes."""
    return pack(materialize(tokenize(df, tokenizer_path, id_col, text_col, end_id), "tokens"), id_col, length, keep_ids)


def sequences(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """Per sequence: tokens, pieces and padding; a sequence whose size is a power of two needs none."""
    n = F.sum("length")
    power = F.expr("bit_count(n_tokens) = 1")
    return (
        pieces.groupBy("sequence_id")
        .agg(n.alias("n_tokens"), F.count("*").alias("n_pieces"))
        .withColumn("padding", F.when(power, F.lit(0)).otherwise(F.lit(length) - F.col("n_tokens")))
    )


