"""The session fold: frames grouped by canonical five-tuple.

A tuple's sides are ordered by (ip text, port). The opener (first pure SYN) is the client; without one the first
observed sender is, unless it sits on a well-known port and the other side does not. One untimed frame makes a
session's start and duration unknown. All of it is one shuffle on the tuple: the ordered parts are windows and
conditional minima over the same partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TUPLE = ["proto", "a", "b"]
#: Registered ports that services listen on, besides those below 1024.
SERVER_PORTS = (1080, 1194, 1433, 1521, 3128, 3306, 3389, 5060, 5061, 5222, 5223, 5228, 5432, 5900, 6379, 8000, 8080, 8443, 8883, 27017)
#: Lower bounds of the frame-length ranges.
LENGTH_BOUNDS = (0, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120)
SYN, ACK, FIN, RST = 2, 16, 1, 4
#: Completeness bits, in the order SYN, SYN+ACK, ACK, data, FIN, RST.
C_SYN, C_SYNACK, C_ACK, C_DATA, C_FIN, C_RST = 1, 2, 4, 8, 16, 32


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(flag) != 0


def endpoint(side: str) -> Column:
    return F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port"))


def with_tuple(frames: DataFrame) -> DataFrame:
    src, dst = endpoint("src"), endpoint("dst")
    return frames.withColumns({"a": F.least(src, dst), "b": F.greatest(src, dst), "src": src, "dst": dst})


def length_bucket(length: Column) -> Column:
    out = F.lit(0)
    for i, low in enumerate(LENGTH_BOUNDS):
        out = F.when(length >= low, F.lit(i)).otherwise(out)
    return out


def likely_server(port: Column) -> Column:
    return (port > 0) & ((port < 1024) | port.isin(*SERVER_PORTS))


def completeness_bits(frames: DataFrame) -> DataFrame:
    """Adds c_bits to each frame. An ACK counts only from the peer of the latest SYN+ACK before it."""
    earlier = Window.partitionBy(*TUPLE).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    syn_ack = has(SYN) & has(ACK)
    answered = F.last(F.when(syn_ack, F.col("src")), ignorenulls=True).over(earlier)
    bit = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0))
    bits = (
        bit(has(SYN) & ~has(ACK), C_SYN)
        .bitwiseOR(bit(syn_ack, C_SYNACK))
        .bitwiseOR(bit(~has(SYN) & has(ACK) & F.coalesce(answered != F.col("src"), F.lit(False)), C_ACK))
        .bitwiseOR(bit(F.col("payload_len") > 0, C_DATA))
        .bitwiseOR(bit(has(FIN), C_FIN))
        .bitwiseOR(bit(has(RST), C_RST))
    )
    return frames.withColumn("c_bits", F.when(F.col("proto") == "tcp", bits).otherwise(F.lit(0)))


def first_filled(col: str) -> Column:
    filled = F.col(col).isNotNull() & (F.trim(F.col(col)) != "")
    return F.min_by(F.when(filled, F.col(col)), F.when(filled, F.col("ordinal")))


def name_answers(frames: DataFrame) -> DataFrame:
    """frames with answers: the addresses that a name answer gives, as an array (null where there are none)."""
    if "dns_answers" in frames.columns:
        return frames.withColumn("answers", F.when(F.size("dns_answers") > 0, F.col("dns_answers")))
    return frames.withColumn("answers", F.when(F.col("dns_answer").isNotNull(), F.array("dns_answer")))


def fold_sessions(frames: DataFrame) -> DataFrame:
    """One row per tuple, with everything the session summary holds."""
    for name in ("sni", "http_host"):
        if name not in frames.columns:
            frames = frames.withColumn(name, F.lit(None).cast("string"))
    rows = completeness_bits(with_tuple(name_answers(frames)))
    from_a = F.col("src") == F.col("a")
    timed = F.struct("ts", "ordinal")
    timed_or_null = F.when(F.col("ts").isNotNull(), timed)
    query = F.col("dns_name").isNotNull() & F.col("rcode").isNull()
    answer = F.col("answers").isNotNull()
    grouped = rows.groupBy(*TUPLE).agg(
        F.min("ordinal").alias("first_ordinal"),
        F.count("*").alias("packets"),
        F.sum("orig_len").alias("bytes"),
        F.sum(F.when(from_a, F.col("orig_len")).otherwise(0)).alias("bytes_a"),
        F.sum(F.when(from_a, 1).otherwise(0)).alias("packets_a"),
        F.sum(F.when(F.col("ts").isNull(), 1).otherwise(0)).alias("untimed"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.min_by("src", "ordinal").alias("first_src"),
        F.min_by("src", timed_or_null).alias("early_src"),
        F.min_by(F.when(has(SYN) & ~has(ACK), F.col("src")), F.when(has(SYN) & ~has(ACK), F.col("ordinal"))).alias("opener"),
        F.max(F.when(has(RST), 1).otherwise(0)).alias("any_rst"),
        F.bit_or("c_bits").alias("completeness"),
        F.min_by("app", "ordinal").alias("app"),
        first_filled("process").alias("process"),
        first_filled("dns_name").alias("dns_query"),
        first_filled("sni").alias("sni"),
        first_filled("http_host").alias("http_host"),
        F.array_distinct(F.flatten(F.collect_set("answers"))).alias("answer_set"),
        F.min(F.when(query, F.col("ts"))).alias("query_ts"),
        F.min(F.when(answer, F.col("ts"))).alias("answer_ts"),
        *[F.sum(F.when(length_bucket(F.col("orig_len")) == i, 1).otherwise(0)).alias(f"len_{i}") for i in range(len(LENGTH_BOUNDS))],
    )
    first = F.when(F.col("untimed") > 0, F.col("first_src")).otherwise(F.col("early_src"))
    other = F.when(first == F.col("a"), F.col("b")).otherwise(F.col("a"))
    flip = F.when(F.col("opener").isNotNull(), F.col("opener") != first).otherwise(likely_server(first["port"]) & ~likely_server(other["port"]))
    client = F.when(flip, other).otherwise(first)
    up_is_a = F.col("client") == F.col("a")
    known = F.col("untimed") == 0
    out = grouped.withColumn("client", client).withColumn("server", F.when(F.col("client") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    return out.select(
        F.concat_ws("|", "proto", F.col("a.ip"), F.col("a.port").cast("string"), F.col("b.ip"), F.col("b.port").cast("string")).alias("session_id"),
        "proto",
        "app",
        F.array("proto", "app").alias("stack"),
        F.col("client.ip").alias("client_ip"),
        F.col("client.port").alias("client_port"),
        F.col("server.ip").alias("server_ip"),
        F.col("server.port").alias("server_port"),
        "first_ordinal",
        F.when(known, F.col("min_ts")).alias("start"),
        F.when(known, (F.unix_micros(F.col("max_ts").cast("timestamp")) - F.unix_micros(F.col("min_ts").cast("timestamp"))) / 1e6).alias("duration"),
        F.when(F.col("any_rst") == 1, "error").otherwise("ok").alias("status"),
        "packets",
        "bytes",
        F.when(up_is_a, F.col("packets_a")).otherwise(F.col("packets") - F.col("packets_a")).alias("packets_up"),
        F.when(up_is_a, F.col("packets") - F.col("packets_a")).otherwise(F.col("packets_a")).alias("packets_down"),
        F.when(up_is_a, F.col("bytes_a")).otherwise(F.col("bytes") - F.col("bytes_a")).alias("bytes_up"),
        F.when(up_is_a, F.col("bytes") - F.col("bytes_a")).otherwise(F.col("bytes_a")).alias("bytes_down"),
        "completeness",
        "process",
        "dns_query",
        "sni",
        "http_host",
        F.size("answer_set").alias("n_answers"),
        F.array_sort("answer_set").alias("dns_answers"),
        F.when(known & (F.col("answer_ts") > F.col("query_ts")), (F.unix_micros(F.col("answer_ts").cast("timestamp")) - F.unix_micros(F.col("query_ts").cast("timestamp"))) / 1e3).alias("latency_ms"),
        "untimed",
        *[f"len_{i}" for i in range(len(LENGTH_BOUNDS))],
    )


def message_tally(frames: DataFrame) -> DataFrame:
    """Per session and kind (method, status): the messages of each key."""
    rows = with_tuple(frames)
    keys = F.array(F.struct(F.lit("method").alias("kind"), F.col("http_method").alias("key")), F.struct(F.lit("status").alias("kind"), F.col("http_status").cast("string").alias("key")))
    long = rows.select(*TUPLE, F.explode(keys).alias("m")).where("m.key IS NOT NULL")
    return long.groupBy(*TUPLE, F.col("m.kind").alias("kind"), F.col("m.key").alias("key")).agg(F.count("*").alias("messages"))


def learned_names(frames: DataFrame) -> DataFrame:
    """address -> the name that the last answer in the capture gave it."""
    named = name_answers(frames).where("answers IS NOT NULL").select(F.explode("answers").alias("address"), "dns_name", "ordinal")
    return named.groupBy("address").agg(F.max_by(F.lower("dns_name"), "ordinal").alias("name"))


def resolve_hosts(sessions: DataFrame, names: DataFrame) -> DataFrame:
    """host, from the first source that has one: the name asked for (name lookups only), the TLS server name, the HTTP
    host, the name learned for the server's address, that address, the client's."""
    joined = sessions.join(names, sessions["server_ip"] == names["address"], "left")
    asked = F.when(F.col("app").isin("dns", "mdns", "llmnr"), F.col("dns_query"))
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("server_ip", "client_ip")]
    return joined.withColumn("host", F.coalesce(asked, "sni", "http_host", "name", *filled, F.lit("unknown"))).drop("address", "name")
