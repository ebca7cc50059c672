"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans.tables import settle as materialize

#: Rows of a few numbers that may be sent to every executor: a million take about 130 MB in a join's hash table.
BROADCAST_ROWS = 1_000_000
#: Rows of text that Spark hands to Python at once: Spark's own 10 000 could be a gigabyte of very long texts.
BATCH_ROWS = 2048
#: Bytes of text that one numpy step works on; one text larger than this is a step of its own.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Mark df for broadcast if its counted rows are few; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand at most BATCH_ROWS rows to Python at once."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive items whose sizes sum to most at the utmost, one item at least."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words (xor-shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
