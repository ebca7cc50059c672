"""Capture files: pcap and pcapng (gzip too) to frame rows and back.

Records of a capture are not self-synchronising, so a file is read by one task; a folder of rotated files is read in
parallel. Files come through Spark's binaryFile reader and so from any store that Spark can read.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic numbers as read little-endian: byte order and ticks per second.
PCAP_MAGIC = {0xA1B2C3D4: ("<", 10**6), 0xD4C3B2A1: (">", 10**6), 0xA1B23C4D: ("<", 10**9), 0x4D3CB2A1: (">", 10**9)}
SECTION, INTERFACE, SIMPLE, ENHANCED = 0x0A0D0D0A, 1, 3, 6
#: A longer record is a corrupt one.
MAX_FRAME = 1_000_000
FRAME_SCHEMA = "path string, ordinal long, ts_ns long, ts timestamp_ntz, orig_len long, cap_len long, link_type int, section int, interface int, bytes binary, problem string"


@dataclass
class Record:
    ts_ns: int | None
    orig_len: int
    link_type: int
    section: int
    interface: int
    data: bytes


class CutShort(Exception):
    """The file ends inside a record, or holds one that can't be right."""


def sniff(head: bytes) -> str:
    if len(head) < 4:
        return "tooShort"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"PK\x03\x04":
        return "zip"
    (word,) = struct.unpack("<I", head[:4])
    return "pcap" if word in PCAP_MAGIC else "pcapng" if word == SECTION else "unknown"


#: What a compressed capture may expand to: bytes in all, and times its own size.
MAX_EXPANDED, MAX_RATIO = 1 << 30, 200


def expanded(data: bytes) -> bytes:
    """A gzip file's content, read in steps and refused where it outgrows its bounds."""
    out, size = [], 0
    most = min(MAX_EXPANDED, max(1 << 20, MAX_RATIO * len(data)))
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        try:
            while part := f.read(1 << 20):
                out.append(part)
                if (size := size + len(part)) > most:
                    raise CutShort("expands too far")
        except (OSError, EOFError) as e:
            if not out:
                raise CutShort("gzip") from e
    return b"".join(out)


def records(data: bytes) -> Iterator[Record]:
    kind = sniff(data)
    if kind == "gzip":
        inner = expanded(data)
        if sniff(inner) == "gzip":
            raise CutShort("compressed twice")
        yield from records(inner)
    elif kind == "pcap":
        yield from _pcap(data)
    elif kind == "pcapng":
        yield from _pcapng(data)
    else:
        raise CutShort(f"not a capture: {kind}")


def _pcap(data: bytes) -> Iterator[Record]:
    order, ticks = PCAP_MAGIC[struct.unpack("<I", data[:4])[0]]
    if len(data) < 24:
        raise CutShort("header")
    link = struct.unpack(order + "I", data[20:24])[0] & 0xFFFF
    at, head = 24, struct.Struct(order + "IIII")
    while at < len(data):
        if at + 16 > len(data):
            raise CutShort("record header")
        sec, frac, cap, orig = head.unpack_from(data, at)
        at += 16
        if cap > MAX_FRAME:
            raise CutShort("record size")
        if at + cap > len(data):
            raise CutShort("record")
        yield Record(sec * 10**9 + frac * (10**9 // ticks), max(orig, cap), link, 0, 0, data[at : at + cap])
        at += cap


def _options(body: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        out.setdefault(code, body[at + 4 : at + 4 + size])
        at += 4 + (size + 3) // 4 * 4
    return out


def _pcapng(data: bytes) -> Iterator[Record]:
    at, section, order, interfaces = 0, -1, "<", []
    while at < len(data):
        if at + 12 > len(data):
            raise CutShort("block header")
        if data[at : at + 4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            section, interfaces = section + 1, []
        kind, size = struct.unpack_from(order + "II", data, at)
        if size < 12 or size % 4 or at + size > len(data):
            raise CutShort("block")
        body = data[at + 8 : at + size - 4]
        at += size
        if kind == INTERFACE:
            link = struct.unpack_from(order + "H", body)[0]
            options = _options(body[8:], order)
            resolution = options.get(9, b"\x06")[0]
            per_second = 2 ** (resolution & 0x7F) if resolution & 0x80 else 10**resolution
            shift = struct.unpack(order + "q", options[14])[0] if len(options.get(14, b"")) == 8 else 0
            interfaces.append((link, per_second, shift))
        elif kind == ENHANCED:
            number, high, low, cap, orig = struct.unpack_from(order + "IIIII", body)
            if number >= len(interfaces) or cap > MAX_FRAME or 20 + cap > len(body):
                raise CutShort("packet block")
            link, per_second, shift = interfaces[number]
            ticks = high << 32 | low
            yield Record(ticks * 10**9 // per_second + shift * 10**9, max(orig, cap), link, section, number, body[20 : 20 + cap])
        elif kind == SIMPLE and interfaces:
            (orig,) = struct.unpack_from(order + "I", body)
            yield Record(None, orig, interfaces[0][0], section, 0, body[4 : 4 + min(orig, len(body) - 4)])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in FRAME_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.timestamp("us"), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, n, problem = [], 0, None
            try:
                for n, r in enumerate(records(content.as_py()), 1):
                    us = None if r.ts_ns is None else r.ts_ns // 1000
                    rows.append((path, n, r.ts_ns, us, r.orig_len, len(r.data), r.link_type, r.section, r.interface, r.data, None))
                    if len(rows) == 4096:
                        yield flush(rows)
                        rows = []
            except CutShort as e:
                problem = str(e)
            if problem:
                rows.append((path, n + 1, None, None, 0, 0, None, None, None, None, problem))
            if rows:
                yield flush(rows)


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """All frames of the captures at path. A file that ends in a damaged record keeps the frames before it and
    gives one last row that names the problem and has no bytes."""
    return split_captures(spark.read.format("binaryFile").load(path).select("path", "content"))


def split_captures(files: DataFrame) -> DataFrame:
    """The frames of capture files given as rows (path, content)."""
    return files.select("path", "content").repartition("path").mapInArrow(_split, FRAME_SCHEMA)


def properties(spark: SparkSession, path: str) -> DataFrame:
    """Per file: format, size, digests, frames, time span, link types."""
    files = spark.read.format("binaryFile").load(path)
    head = F.substring("content", 1, 4)
    kind = (
        F.when(head.isin(*[F.lit(struct.pack("<I", m)) for m in PCAP_MAGIC]), "pcap").when(head == F.lit(b"\x0a\x0d\x0d\x0a"), "pcapng").when(F.substring("content", 1, 2) == F.lit(b"\x1f\x8b"), "gzip").otherwise("unknown")
    )
    facts = files.select("path", kind.alias("format"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.sha1("content").alias("sha1"))
    counts = read_capture(spark, path).groupBy("path").agg(
        F.count("bytes").alias("frames"), F.sum("orig_len").alias("bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_set("link_type")).alias("link_types"), F.max("problem").alias("problem")
    )
    return facts.join(counts, "path", "left")


def pcap_bytes(rows, link_type: int, nanos: bool = False) -> bytes:
    """A pcap file from (ts_ns, orig_len, data) rows; an untimed frame is written with time zero."""
    out = [struct.pack("<IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 262_144, link_type)]
    for ts, orig, data in rows:
        sec, rest = divmod(ts or 0, 10**9)
        out += [struct.pack("<IIII", sec, rest if nanos else rest // 1000, len(data), orig), data]
    return b"".join(out)


def write_captures(frames: DataFrame, folder: str, link_type: int = 1) -> DataFrame:
    """One pcap per `file` value, as (file, content) rows in a Parquet table at folder; every file in frame order."""

    def pack(table: pa.Table) -> pa.Table:
        t = table.sort_by("ordinal")
        rows = zip(t.column("ts_ns").to_pylist(), t.column("orig_len").to_pylist(), t.column("bytes").to_pylist(), strict=True)
        return pa.table({"file": pa.array([t.column("file")[0].as_py()], pa.int64()), "content": pa.array([pcap_bytes(rows, link_type)], pa.binary())})

    out = frames.select(F.col("file").cast("long"), "ordinal", "ts_ns", "orig_len", "bytes").groupBy("file").applyInArrow(pack, "file long, content binary")
    out.write.mode("overwrite").parquet(folder)
    return frames.sparkSession.read.parquet(folder)
