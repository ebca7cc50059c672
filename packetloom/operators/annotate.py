"""What people add to a capture: names, tags, owners of ports; and projections for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.net import first_number


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """address, name from a hosts file: the first name of a line; comments and blank lines are left out."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = F.split("line", r"\s+")
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("address"), parts[1].alias("name"))


def with_names(sessions: DataFrame, names: DataFrame, host: str = "host") -> DataFrame:
    """A given name replaces the host only where that is a bare address."""
    n = names.groupBy("address").agg(F.min("name").alias("given"))
    return sessions.join(n, sessions[host] == n["address"], "left").withColumn(host, F.coalesce("given", host)).drop("address", "given")


def with_tags(sessions: DataFrame, tags: DataFrame) -> DataFrame:
    return sessions.join(tags.groupBy("session_id").agg(F.min("tag").alias("tag")), "session_id", "left")


def with_owners(sessions: DataFrame, owners: DataFrame) -> DataFrame:
    """Process names from a (port, process) table where the capture has none."""
    o = owners.groupBy(F.col("port").alias("client_port")).agg(F.min("process").alias("owner"))
    return sessions.join(o, "client_port", "left").withColumn("process", F.coalesce("process", "owner")).drop("owner")


def flow_lanes(frames: DataFrame, lanes: int = 12) -> DataFrame:
    """Frames between the first `lanes` addresses, which are numbered in first-seen order (a drawing's width)."""
    long = frames.select("ordinal", F.posexplode(F.array("src_ip", "dst_ip")).alias("side", "ip"))
    first = long.groupBy("ip").agg(F.min(F.struct("ordinal", "side")).alias("seen")).orderBy("seen").limit(lanes)
    numbered = first.select("ip", (F.row_number().over(Window.orderBy("seen")) - 1).alias("lane"))
    a, b = numbered.select(F.col("ip").alias("src_ip"), F.col("lane").alias("from_lane")), numbered.select(F.col("ip").alias("dst_ip"), F.col("lane").alias("to_lane"))
    return frames.join(F.broadcast(a), "src_ip").join(F.broadcast(b), "dst_ip").select("ordinal", "from_lane", "to_lane")


def field_points(frames: DataFrame, column: str, stride: int) -> DataFrame:
    """The first number in a text field, every stride-th frame by ordinal."""
    return frames.where((F.col("ordinal") - 1) % stride == 0).select("ordinal", first_number(F.col(column).cast("string")).alias("value")).where("value IS NOT NULL")


def ladder(frames: DataFrame, session_key: list[str], steps: int = 80) -> DataFrame:
    """The first `steps` frames of each session as numbered steps with their direction."""
    w = Window.partitionBy(*session_key).orderBy("ordinal")
    return frames.withColumn("step", F.row_number().over(w)).where(F.col("step") <= steps).select(*session_key, "step", "ordinal", F.when(F.col("reply"), "down").otherwise("up").alias("direction"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
