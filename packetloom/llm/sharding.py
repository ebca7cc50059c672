"""Byte-balanced shards by Karmarkar-Karp differencing over groups of equal texts.

A partial partition is one load for each shard. Differencing repeatedly takes the two partial partitions with
the largest spread and adds them in opposite order. Groups are dealt by hash to blocks; each block is
differenced in a task of its own and its result, again a partial partition, is differenced with those of the
other blocks. Groups so large that they would fill a good part of a shard (at most
shards / LARGE_SHARE of them can exist) are placed first; each block then starts from its share of their loads, so that it fills the
shards they left lighter.

Defined cases: a null text has no bytes and is a group apart from the empty text. Repeated rows with equal
texts stay together and get slots of their own. Rows with a null key are placed like others. An empty table
gives an empty result. A group heavier than an even share of all bytes makes its shard that heavy: groups are
indivisible. Extra columns pass through; the result columns replace columns of the same name.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.common import materialize, small

#: Bytes that every row costs besides its text.
ROW_BYTES = 8
#: A group above this share of an even shard is placed ahead of the blocks.
LARGE_SHARE = 1 / 2
#: Groups in a block, on average: at most, and at least while there are fewer than SPREAD_BLOCKS blocks.
BLOCK_GROUPS = 200_000
LEAST_GROUPS = 400
SPREAD_BLOCKS = 256
#: Rows that share a slot counter, on average.
SLOT_ROWS = 20_000
LEAST_BUCKETS = 64


def difference(nodes: np.ndarray) -> np.ndarray:
    """nodes: one partial partition (row of loads) each. Returns, for each node and column, its final place."""
    n, width = nodes.shape
    if not n:
        return np.zeros((0, width), np.int64)
    orders = [np.argsort(-x, kind="stable") for x in nodes]
    loads = [x[o] for x, o in zip(nodes, orders, strict=True)]
    heap = [(-float(x[0] - x[-1]), i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        raw = loads[a] + loads[b][::-1]
        order = np.argsort(-raw, kind="stable")
        loads[a] = loads[b] = None
        merges.append((a, b, order))
        loads.append(raw[order])
        heapq.heappush(heap, (-float(raw[order[0]] - raw[order[-1]]), len(loads) - 1))
    places: list = [None] * len(loads)
    places[-1] = np.arange(width)
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        at = np.empty(width, np.int64)
        at[order] = places[n + i]
        places[n + i] = None
        places[a], places[b] = at, at[::-1]
    out = np.empty((n, width), np.int64)
    for i, o in enumerate(orders):
        out[i, o] = places[i]
    return out


def difference_items(sizes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Shard of each single item, given loads that the shards already have."""
    width = len(start)
    nodes = np.zeros((len(sizes) + 1, width))
    nodes[0] = start
    nodes[1:, 0] = sizes
    placed = difference(nodes)
    shard_at = np.empty(width, np.int64)
    shard_at[placed[0]] = np.arange(width)  # the final place that holds shard s's first load is shard s
    return shard_at[placed[1:, 0]]


def merge_blocks(loads: np.ndarray, start: np.ndarray) -> np.ndarray:
    """loads: blocks x shards. Final shard for each block and local shard: differencing among the shards
    that had equal loads before the blocks; shards already loaded by a large group keep their own."""
    out = np.tile(np.arange(loads.shape[1]), (len(loads), 1))
    for value in np.unique(start):
        same = np.flatnonzero(start == value)
        if len(same) > 1 and len(loads):
            out[:, same] = same[difference(loads[:, same].astype(float))]
    return out


def shard_groups(groups: DataFrame, shards: int, keys: list[str]) -> DataFrame:
    """groups: keys and bytes, one row each -> keys and shard."""
    spark = groups.sparkSession
    total, n = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    limit = max(1, int(total / shards * LARGE_SHARE))
    large = groups.where(F.col("bytes") > limit).orderBy(F.desc("bytes"), *keys).collect()  # total / limit rows at most
    start = np.zeros(shards)
    if large:
        sizes = np.array([r.bytes for r in large], float)
        placed = difference_items(sizes, start)
        np.add.at(start, placed, sizes)
    fixed = spark.createDataFrame([(*[r[k] for k in keys], int(s)) for r, s in zip(large, placed if large else [], strict=True)], groups.select(*keys).schema.add("shard", T.IntegerType()))
    rest_bytes = max(1.0, float(total) - start.sum())
    blocks = max(1, -(-n // BLOCK_GROUPS), min(SPREAD_BLOCKS, n // LEAST_GROUPS))
    block = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(blocks)).cast("int")
    rest = groups.where(F.col("bytes") <= limit).withColumn("block", block)
    names = [*keys, "block", "local", "bytes"]

    def run(table: pa.Table) -> pa.Table:
        # Any order of rows gives a valid result; a fixed one makes a retried task give the same.
        table = table.sort_by([("bytes", "descending"), *[(k, "ascending") for k in keys]])
        sizes = table.column("bytes").to_numpy().astype(float)
        local = difference_items(sizes, start * (sizes.sum() / rest_bytes))
        return table.append_column("local", pa.array(local.astype(np.int32))).select(names)

    schema = rest.select(*keys, "block").schema.add("local", T.IntegerType()).add("bytes", T.LongType())
    local = materialize(rest.groupBy("block").applyInArrow(run, schema), "blocks")
    sums = local.groupBy("block", "local").agg(F.sum("bytes").alias("bytes")).collect()  # blocks x shards numbers
    ids = sorted({r.block for r in sums})
    loads = np.zeros((len(ids), shards))
    at = {b: i for i, b in enumerate(ids)}
    for r in sums:
        loads[at[r.block], r.local] = r.bytes
    final = merge_blocks(loads, start)
    moves = spark.createDataFrame([(b, j, int(final[i, j])) for i, b in enumerate(ids) for j in range(shards)], "block int, local int, shard int")
    return local.join(small(moves, len(ids) * shards), ["block", "local"]).select(*keys, "shard").union(fixed.select(*keys, "shard"))


def with_slots(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df (with shard) and slot: gapless from 0 in every shard, counted in buckets so that no shard is one group."""
    buckets = max(LEAST_BUCKETS, rows // SLOT_ROWS)
    dealt = df.withColumn("bucket_", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket_").agg(F.count("*").alias("n_"))
    before = Window.partitionBy("shard").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy("shard", "bucket_").orderBy(*order)
    ranked = dealt.withColumn("slot", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["shard", "bucket_"]).withColumn("slot", (F.col("slot") + F.col("base_")).cast("long")).drop("bucket_", "base_")


def shard_by_bytes(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its text, with size, text_crc32, shard and slot. Equal texts share a shard."""
    made = {"size", "text_crc32", "shard", "slot", text_col}
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keys = ["h1_", "h2_", "null_"]
    sized = df.select(
        *[c for c in df.columns if c not in made],
        (F.octet_length(raw) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("h1_"),
        F.xxhash64(F.lit(23), F.col(text_col)).alias("h2_"),
        F.col(text_col).isNull().alias("null_"),
    )
    sized = materialize(sized, "sized")
    groups = materialize(sized.groupBy(*keys).agg(F.sum("size").alias("bytes")), "groups")
    placed = materialize(sized.join(shard_groups(groups, shards, keys), keys).drop(*keys), "placed")
    return with_slots(placed, [id_col], placed.count())
