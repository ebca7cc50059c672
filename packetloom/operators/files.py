"""Operations on whole captures: select, merge, split, trim, remove duplicates, rename addresses, pages."""

from __future__ import annotations

import pickle
from collections import deque
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.ordered import walk
from packetloom.plans.tables import settle


def merge(captures: list[DataFrame]) -> DataFrame:
    """Frames of several captures by (ts, source, ordinal), with source; a capture with an untimed frame is refused
    when the merge runs."""
    named = [c.withColumn("source", F.lit(i)) for i, c in enumerate(captures)]
    both = reduce(DataFrame.unionByName, named)
    checked = F.when(F.col("ts").isNull(), F.raise_error(F.lit("a frame without a time can't be merged"))).otherwise(F.col("ts"))
    return both.withColumn("ts", checked).orderBy("ts", "source", "ordinal")


def split_by_frames(frames: DataFrame, n: int) -> DataFrame:
    return frames.withColumn("file", F.floor((F.col("ordinal") - 1) / n))


def truncate(frames: DataFrame, snaplen: int, bytes_col: str = "bytes") -> DataFrame:
    if not 14 <= snaplen <= 262_144:
        raise ValueError("a snapshot length is 14 to 262144")
    return frames.withColumn(bytes_col, F.substring(bytes_col, 1, snaplen))


def of_sessions(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Frames whose tuple is among the kept sessions (semi join)."""
    key = ["proto", "client_ip", "client_port", "server_ip", "server_port"]
    return frames.join(sessions.select(*key).distinct(), key, "left_semi")


def without(frames: DataFrame, ignored: DataFrame) -> DataFrame:
    return frames.join(ignored.select("ordinal"), "ordinal", "left_anti")


#: Ordinals in a block of drop_repeats, and its rounds over all blocks that are not settled.
REPEAT_BLOCK = 262_144
REPEAT_ROUNDS = 4


def drop_repeats(frames: DataFrame, content: list[str], window: int = 5, block: int = REPEAT_BLOCK) -> DataFrame:
    """Drop a frame that equals one of the `window` kept frames before it.

    Whether a frame is kept depends on every frame kept before it. Blocks of ordinals are walked side by side, each from the
    frames that the block before it was last seen to end with (at first: none), until no block's start changes; only then
    are the kept frames given. A block's end hardly ever depends on its start, so two rounds do. Where it does, as with
    contents that recur in step, blocks are walked one after the other from the fifth round on, each once more. A task
    holds the rows of a few blocks, the driver `window` frames' contents a block."""
    names = frames.columns
    rows = frames.withColumn("block_", F.floor(F.col("ordinal") / block))
    blocks = [r[0] for r in rows.select("block_").distinct().orderBy("block_").collect()]
    if len(blocks) > 1:
        rows = settle(rows, "repeats")
    start: dict[int, tuple] = {b: () for b in blocks}

    class Kept:
        def __init__(self, start: dict[int, tuple]):
            self.start, self.kept = start, None

        def fresh(self, row: dict) -> bool:
            if self.kept is None:
                self.kept = deque(self.start[row["block_"]], maxlen=window)
            what = tuple(row[c] for c in content)
            if what in self.kept:
                return False
            self.kept.append(what)
            return True

    class Rows(Kept):
        def add(self, row: dict) -> list[tuple]:
            return [tuple(row[c] for c in names)] if self.fresh(row) else []

        def finish(self) -> list[tuple]:
            return []

    class End(Kept):
        def add(self, row: dict) -> list[tuple]:
            self.fresh(row)
            return []

        def finish(self) -> list[tuple]:
            return [(pickle.dumps(tuple(self.kept)),)]

    def ends(of: list[int]) -> dict[int, tuple]:
        known = {b: start[b] for b in of}
        schema = T.StructType([T.StructField("block_", T.LongType()), T.StructField("end", T.BinaryType())])
        found = walk(rows.where(F.col("block_").isin(of)).select("block_", "ordinal", *[c for c in content if c != "ordinal"]), ["block_"], ["ordinal"], lambda: End(known), schema, len(of))
        return {r["block_"]: pickle.loads(r["end"]) for r in found.collect()}

    end: dict[int, tuple] = {}
    stale, rounds = set(blocks[:-1]), 0
    while stale:
        # The first of them starts from a settled end.
        todo = sorted(stale)[: None if rounds < REPEAT_ROUNDS else 1]
        end |= ends(todo)
        stale -= set(todo)
        rounds += 1
        for before, after in pairwise(blocks):
            if end[before] != start[after]:
                start[after] = end[before]
                if after != blocks[-1]:
                    stale.add(after)
    schema = T.StructType([T.StructField("block_", T.LongType()), *frames.schema.fields])
    return walk(rows, ["block_"], ["ordinal"], lambda: Rows(start), schema, max(1, len(blocks))).drop("block_")


def anonymise(frames: DataFrame, columns: tuple[str, ...] = ("src_ip", "dst_ip")) -> DataFrame:
    """Addresses replaced consistently by numbers in first-seen order (10.x.y.z)."""
    long = frames.select(F.col("ordinal"), F.posexplode(F.array(*columns)).alias("side", "ip"))
    first = long.where("ip IS NOT NULL").groupBy("ip").agg(F.min(F.struct("ordinal", "side")).alias("at"))
    # One row per distinct address: ranked in blocks of ordinals so that no single task ranks them all.
    slot = F.floor(F.col("at.ordinal") / 65_536)
    counts = first.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    base = counts.select("slot", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = first.withColumn("slot", slot).withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("at"))).join(base, "slot")
    number = F.col("r") + F.col("base")
    octet = lambda i: F.floor(number / 256**i) % 256
    names = ranked.select("ip", F.concat_ws(".", F.lit("10"), *[octet(i).cast("string") for i in (2, 1, 0)]).alias("as"))
    out = frames
    for c in columns:
        out = out.join(names.select(F.col("ip").alias(c), F.col("as").alias(f"{c}_as_")), c, "left").drop(c).withColumnRenamed(f"{c}_as_", c)
    return out


def page(rows: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """Keyset page: rows after a cursor in descending order; 1 to 500 rows."""
    if not 1 <= size <= 500:
        raise ValueError("a page has 1 to 500 rows")
    if after is not None:
        key: Column = F.struct(*[F.col(c) for c in order])
        rows = rows.where(key < F.struct(*[F.lit(v).alias(c) for c, v in zip(order, after, strict=True)]))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(size)


def retained(captures: DataFrame, max_count: int, max_sessions: int) -> DataFrame:
    """The newest captures whose number and summed sessions stay in bounds (a prefix; captures are few)."""
    newest = Window.orderBy(F.desc("ended_at"), F.desc("id"))
    upto = newest.rowsBetween(Window.unboundedPreceding, 0)
    ranked = captures.withColumns({"n_": F.row_number().over(newest), "sum_": F.sum("sessions").over(upto)})
    return ranked.where((F.col("n_") <= max_count) & (F.col("sum_") <= max_sessions)).drop("n_", "sum_")


def find_bytes(frames: DataFrame, needle: bytes, column: str = "bytes") -> DataFrame:
    return frames.where(F.contains(F.col(column), F.lit(needle)))
