"""Intervals between two cited frames of a connection, from conditional minima over its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ["tuple_id", "incarnation"]


def connection_timings(events: DataFrame) -> DataFrame:
    """Handshake reply (the answered SYN to the first SYN+ACK) and application response (the opener's first payload to
    the other side's next), as conditional minima: kind, start_ordinal, end_ordinal per connection."""
    k, o, way = F.col("kind"), F.col("ordinal"), F.col("way")
    first = events.groupBy(*ID).agg(F.min(F.when(k == "synAck", o)).alias("syn_ack"), F.min_by(F.when(k == "syn", way), F.when(k == "syn", o)).alias("opener"))
    rows = events.where("kind IN ('syn', 'payloadObserved')").join(first, ID)
    asked = F.min(F.when((k == "payloadObserved") & (way == F.col("opener")), o))
    sent = rows.groupBy(*ID, "syn_ack", "opener").agg(F.max(F.when((k == "syn") & (o <= F.col("syn_ack")), o)).alias("syn"), asked.alias("asked"))
    replies = rows.where("kind = 'payloadObserved'").select(*ID, "ordinal", "way").join(sent.where("asked IS NOT NULL").select(*ID, "opener", "asked"), ID)
    answered = replies.where((way != F.col("opener")) & (o > F.col("asked"))).groupBy(*ID).agg(F.min("ordinal").alias("answered"))
    g = sent.join(answered, ID, "left")
    kinds = F.array(F.struct(F.lit("tcpHandshakeReply").alias("kind"), F.col("syn").alias("start"), F.col("syn_ack").alias("end")), F.struct(F.lit("applicationResponse").alias("kind"), F.col("asked").alias("start"), F.col("answered").alias("end")))
    out = g.select(*ID, F.explode(kinds).alias("t"))
    return out.where("t.start IS NOT NULL AND t.end IS NOT NULL").select(*ID, F.col("t.kind").alias("kind"), F.col("t.start").alias("start_ordinal"), F.col("t.end").alias("end_ordinal"))


def measured(timings: DataFrame, frames: DataFrame) -> DataFrame:
    """timings with elapsed seconds; null where either frame is untimed or time runs backwards."""
    at = frames.select("ordinal", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a, b = at.select(F.col("ordinal").alias("start_ordinal"), F.col("us").alias("u0")), at.select(F.col("ordinal").alias("end_ordinal"), F.col("us").alias("u1"))
    gap = F.col("u1") - F.col("u0")
    return timings.join(a, "start_ordinal").join(b, "end_ordinal").withColumn("elapsed", F.when(gap >= 0, gap / 1e6)).drop("u0", "u1")


def dns_exchanges(frames: DataFrame) -> DataFrame:
    """Each transaction id's first query and the first response after it; a retry does not restart the interval."""
    dns = frames.where("dns_id IS NOT NULL")
    key = ["client_ip", "client_port", "server_ip", "dns_id"]
    asked = dns.where("NOT reply").groupBy(*key).agg(F.min("ordinal").alias("start_ordinal"))
    answers = dns.where("reply").join(asked, key).where("ordinal > start_ordinal")
    return answers.groupBy(*key, "start_ordinal").agg(F.min("ordinal").alias("end_ordinal"))
