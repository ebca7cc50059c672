"""Orders, pages and texts of listings: chronologies, sort keys, times as text, filter terms, roll-ups of endpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.windows import BLOCK
from packetloom.plans.tables import settle

PAGE_ROWS = 200_000


def chronological(sessions: DataFrame, descending: bool = False) -> DataFrame:
    """Sessions by start, then in capture order; those of unknown start come last both ways. Sorted, not numbered: a
    range sort needs no single task."""
    start = F.desc_nulls_last("start") if descending else F.asc_nulls_last("start")
    return sessions.orderBy(start, F.desc("first_ordinal") if descending else F.asc("first_ordinal"))


def column_order(rows: DataFrame, column: str, descending: bool = False, tie: str = "first_ordinal") -> DataFrame:
    """Rows by one column: texts without regard to case, missing values last, ties in capture order."""
    key = F.lower(column) if dict(rows.dtypes)[column] == "string" else F.col(column)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.asc(tie))


def tree_order(nodes: DataFrame, count: str = "count", name: str = "name") -> DataFrame:
    """Most first, names downward among equals."""
    return nodes.orderBy(F.desc(count), F.desc(name))


def page_by_ordinal(frames: DataFrame, first: int, rows: int) -> DataFrame:
    """So many frames from an ordinal on; the bounds reach the scan as a filter."""
    if first < 1 or not 1 <= rows <= PAGE_ROWS:
        raise ValueError(f"a page begins at 1 or later and has 1 to {PAGE_ROWS} rows")
    return frames.where(F.col("ordinal").between(first, first + rows - 1))


def split_by_seconds(frames: DataFrame, seconds: float, block_rows: int = 1_000_000) -> DataFrame:
    """file: number of the file that a frame goes to, from 0. A file starts at its first frame, and the first frame that
    is `seconds` or more later starts the next. Frames without a time are refused.

    Only frames later than all before them can start a file. These are dealt by time into blocks; every block works out,
    for each of its frames, the last file that starts in it if that frame starts one. The chain of files then takes one
    look-up a block, and no task more than a block."""
    if not frames.where("ts IS NULL").isEmpty():
        raise ValueError("frames without a time can't be split by time")
    span = int(seconds * 1_000_000)
    block = F.floor(F.col("ordinal") / BLOCK).alias("block_")
    rows = frames.select("ordinal", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), block)
    before = Window.partitionBy("block_").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("block_").agg(F.max("us").alias("top")).select("block_", F.max("top").over(Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    records = rows.withColumn("top", F.max("us").over(before)).join(carried, "block_")
    records = settle(records.where(F.greatest("top", "carry").isNull() | (F.col("us") > F.greatest("top", "carry"))).select("ordinal", "us"), "records")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ordinal, us = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.searchsorted(us, us + span)
            last = np.where(last < len(us), last, np.arange(len(us)))
            while (last[last] != last).any():
                last = last[last]
            part = np.full(len(us), TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(ordinal), pa.array(us), pa.array(us[last])], names=["part", "ordinal", "us", "last_us"])

    dealt = records.repartitionByRange(-(-records.count() // block_rows) or 1, "us").sortWithinPartitions("us")
    table = settle(dealt.mapInArrow(chain, "part int, ordinal long, us long, last_us long"), "chains")
    entries, due = [], None
    for b in table.groupBy("part").agg(F.min("us").alias("low"), F.max("us").alias("high")).orderBy("low").collect():
        due = b.low if due is None else due
        if due <= b.high:
            hit = table.where((F.col("part") == b.part) & (F.col("us") >= due)).agg(F.min(F.struct("us", "last_us")).alias("m")).first().m
            entries.append((b.part, hit.us))
            due = hit.last_us + span
    if not entries:
        return frames.withColumn("file", F.lit(0).cast("long"))

    def starts(key: tuple, block_: pa.Table) -> pa.Table:
        sorted_ = block_.sort_by("us")
        us, ordinal = sorted_["us"].to_numpy(), sorted_["ordinal"].to_numpy()
        at, found = int(np.searchsorted(us, sorted_["entry"][0].as_py())), []
        while at < len(us):
            found.append(at)
            at = int(np.searchsorted(us, us[at] + span))
        return pa.table({"ordinal": ordinal[found], "starts_": np.ones(len(found), np.int32)})

    entered = table.join(F.broadcast(table.sparkSession.createDataFrame(entries, "part int, entry long")), "part")  # one row a block
    marks = entered.groupBy("part").applyInArrow(starts, "ordinal long, starts_ int")
    marked = frames.join(marks, "ordinal", "left").withColumn("block_", F.floor(F.col("ordinal") / BLOCK))
    upto = Window.partitionBy("block_").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    counts = marks.groupBy(F.floor(F.col("ordinal") / BLOCK).alias("block_")).agg(F.sum("starts_").alias("n"))
    blocks = marked.select("block_").distinct().join(counts, "block_", "left").select("block_", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carry_"))
    own = F.coalesce(F.sum("starts_").over(upto), F.lit(0))
    return marked.withColumn("own_", own).join(blocks, "block_").withColumn("file", (F.col("own_") + F.col("carry_") - 1).cast("long")).drop("block_", "own_", "carry_", "starts_")


def relative_ack(frames: DataFrame) -> DataFrame:
    """rel_ack: the acknowledged number from the peer's origin (its last pure SYN or SYN+ACK before, else its first
    sequence number seen)."""
    src, dst = (F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")) for s in ("src", "dst"))
    upto = Window.partitionBy("proto", F.least(src, dst), F.greatest(src, dst)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    from_low = src < dst
    opens = F.col("flags").bitwiseAND(2) != 0

    def origin(side: Column) -> Column:
        return F.coalesce(F.last(F.when(side & opens, F.col("seq")), ignorenulls=True).over(upto), F.first(F.when(side, F.col("seq")), ignorenulls=True).over(upto))

    rows = frames.withColumns({"low_": origin(from_low), "high_": origin(~from_low)})
    return rows.withColumn("rel_ack", F.pmod(F.col("ack") - F.when(from_low, F.col("high_")).otherwise(F.col("low_")), F.lit(1 << 32))).drop("low_", "high_")


def shown_deltas(frames: DataFrame, shown: Column) -> DataFrame:
    """Shown frames with the microseconds since the shown frame before them, in blocks of ordinals."""
    from packetloom.operators.windows import deltas

    return deltas(frames.where(shown))


def time_texts(ts: Column, first: Column) -> dict[str, Column]:
    """A time as seconds since the epoch, as UTC date and time, as time of day and as seconds since a first one."""
    us = F.unix_micros(ts.cast("timestamp"))
    fraction = F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0")
    whole = F.timestamp_seconds(F.floor(us / 1_000_000))
    since = us - F.unix_micros(first.cast("timestamp"))
    return {
        "epoch": F.concat(F.floor(us / 1_000_000).cast("string"), F.lit("."), fraction),
        "utc": F.concat(F.date_format(whole, "yyyy-MM-dd HH:mm:ss"), F.lit("."), fraction),
        "time_of_day": F.concat(F.date_format(whole, "HH:mm:ss"), F.lit("."), fraction),
        "since_first": F.concat(F.floor(since / 1_000_000).cast("string"), F.lit("."), F.lpad(F.pmod(since, F.lit(1_000_000)).cast("string"), 6, "0")),
    }


def conversation_terms(sessions: DataFrame) -> DataFrame:
    """(session_id, layer, term): the filter terms that keep a session's conversation, at each layer that it has. MAC
    addresses where the sessions carry client_mac and server_mac; equal ports are written once."""
    addresses = F.concat(F.lit("ip == "), "client_ip", F.lit(" and ip == "), "server_ip")
    port = lambda c: F.concat(F.lit("port == "), F.col(c).cast("string"))
    ports = F.when(F.col("client_port") == F.col("server_port"), port("client_port")).otherwise(F.concat(port("client_port"), F.lit(" and "), port("server_port")))
    version = F.when(F.col("client_ip").contains(":"), "IPv6").otherwise("IPv4")
    option = lambda layer, term: F.struct(layer.alias("layer"), term.alias("term"))
    options = [option(version, addresses)]
    for name in ("tcp", "udp"):
        options.append(F.when(F.col("proto") == name, option(F.lit(name.upper()), F.concat(F.lit(f"{name} and "), addresses, F.lit(" and "), ports))))
    if {"client_mac", "server_mac"} <= set(sessions.columns):
        options.append(F.when(F.col("client_mac").isNotNull() & F.col("server_mac").isNotNull(), option(F.lit("Ethernet"), F.concat(F.lit("mac == "), "client_mac", F.lit(" and mac == "), "server_mac"))))
    rows = sessions.withColumn("option_", F.explode(F.filter(F.array(*options), lambda o: o.isNotNull() & o["term"].isNotNull())))
    return rows.select("session_id", F.col("option_.layer").alias("layer"), F.col("option_.term").alias("term"))


def remote_endpoints(sessions: DataFrame) -> DataFrame:
    """Per server address: sessions, clients, bytes, and the span of capture order that they cover."""
    return sessions.groupBy("server_ip").agg(F.count("*").alias("sessions"), F.count_distinct("client_ip").alias("clients"), F.sum("bytes").alias("bytes"), F.min("first_ordinal").alias("first_ordinal"), F.max("first_ordinal").alias("last_ordinal"))


def subnets(frames: DataFrame, bits: int = 24, number: Callable[[Column], Column] | None = None) -> DataFrame:
    """IPv4 endpoints rolled up to networks of so many bits: addresses, frames and bytes sent and received. number gives an
    address text's value (net.ipv4_number). Frames are summed by address first, so a network's are never gathered."""
    from packetloom.functions.net import ipv4_number, ipv4_text, network_of

    side = lambda c, sent: frames.select(F.col(c).alias("ip"), F.col("orig_len").alias("n"), F.lit(sent).alias("sent"))
    both = side("src_ip", 1).unionByName(side("dst_ip", 0))
    sums = {"frames_sent": F.sum("sent"), "frames_received": F.sum(1 - F.col("sent")), "bytes_sent": F.sum(F.col("n") * F.col("sent")), "bytes_received": F.sum(F.col("n") * (1 - F.col("sent")))}
    per = both.groupBy("ip").agg(*[c.alias(n) for n, c in sums.items()])
    per = per.withColumn("net", network_of((number or ipv4_number)(F.col("ip")), bits)).where("net IS NOT NULL")
    g = per.groupBy("net").agg(F.count("*").alias("addresses"), *[F.sum(n).alias(n) for n in sums])
    return g.select(F.concat(ipv4_text(F.col("net")), F.lit(f"/{bits}")).alias("network"), "addresses", *sums)


def dns_statistics(frames: DataFrame) -> DataFrame:
    """The tree of name messages: all, by kind, by answer code below replies, by name below queries; count and bytes."""
    dns = frames.where("dns_id IS NOT NULL")
    kind = F.when(F.col("reply"), "responses").otherwise("queries")
    leaf = F.when(F.col("reply"), F.concat(F.lit("rcode "), F.coalesce("rcode", F.lit(0)).cast("string"))).otherwise(F.lower("dns_name"))
    return dns.select(kind.alias("kind"), leaf.alias("leaf"), "orig_len").rollup("kind", "leaf").agg(F.count("*").alias("count"), F.sum("orig_len").alias("bytes"))


def http_statistics(frames: DataFrame) -> DataFrame:
    """The tree of HTTP messages: requests by method, responses by class and code."""
    http = frames.where("http_method IS NOT NULL OR http_status IS NOT NULL")
    kind = F.when(F.col("http_method").isNotNull(), "requests").otherwise("responses")
    group = F.coalesce("http_method", F.concat(F.floor(F.col("http_status") / 100).cast("string"), F.lit("xx")))
    leaf = F.coalesce(F.col("http_status").cast("string"), F.col("http_method"))
    return http.select(kind.alias("kind"), group.alias("group"), leaf.alias("leaf")).rollup("kind", "group", "leaf").agg(F.count("*").alias("count"))
