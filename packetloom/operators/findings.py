"""Findings: what connection events and DNS, ICMP and TLS facts say about a session, with cited frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CITATIONS = 16
NOTE, WARNING = 0, 1
#: Event kinds and the finding kind they support.
EVENT_FINDINGS = {
    "rst": "reset", "retransmission": "retransmission", "overlap": "overlap", "outOfOrderBuffered": "outOfOrder", "pendingOverflow": "outOfOrder",
    "zeroWindow": "zeroWindow", "zeroWindowProbe": "zeroWindow", "zeroWindowProbeAcknowledgement": "zeroWindow", "windowFull": "windowFull",
    "duplicateAcknowledgement": "duplicateAck", "keepAlive": "keepAlive", "fastRetransmission": "fastRetransmission",
    "spuriousRetransmission": "spuriousRetransmission", "ambiguousTupleReuse": "tupleReuse", "ackedUnseenSegment": "ackedUnseen",
}
NOTES = ("keepAlive", "duplicateAck", "windowFull")
ID = ["tuple_id", "incarnation"]


def severity(kind: Column) -> Column:
    return F.when(kind.isin(*NOTES), NOTE).otherwise(WARNING)


def _cited(rows: DataFrame, key: list[str]) -> DataFrame:
    """Frames per finding: the first CITATIONS ordinals and how many there are in all. The ranking is limited before
    the shuffle, so a finding with very many frames never gathers them."""
    by = [*key, "kind"]
    each = rows.groupBy(*by, "ordinal").agg(F.lit(1).alias("one"))
    counts = each.groupBy(*by).agg(F.count("*").alias("cited"), F.min("ordinal").alias("first_cited"))
    ranked = each.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy("ordinal"))).where(F.col("rank_") <= CITATIONS)
    return counts.join(ranked.groupBy(*by).agg(F.array_sort(F.collect_list("ordinal")).alias("citations")), by)


def from_events(events: DataFrame) -> DataFrame:
    """One finding per connection and kind."""
    kind = F.lit(None).cast("string")
    for name, found in EVENT_FINDINGS.items():
        kind = F.when(F.col("kind") == name, F.lit(found)).otherwise(kind)
    return _cited(events.withColumn("kind", kind).where("kind IS NOT NULL"), ID)


def from_lifecycle(events: DataFrame) -> DataFrame:
    """Refused, unanswered, aborted and half-closed connections.

    Conditional minima in two passes (the second looks at what follows the first pass's FIN and RST), so that no
    connection's events are ever gathered."""
    k, o = F.col("kind"), F.col("ordinal")
    has = lambda name: F.max(F.when(k == name, 1).otherwise(0)) == 1
    frame = events.groupBy(*ID, "ordinal", "way").agg(*[has(n).alias(a) for n, a in (("syn", "syn"), ("rst", "rst"), ("fin", "fin"), ("payloadObserved", "payload"), ("retransmission", "resent"))])
    ends = events.groupBy(*ID).agg(*[F.max_by(c, "ordinal").alias(c) for c in ("phase", "handshake", "close")])
    at = lambda cond: F.min(F.when(cond, o))
    first = frame.groupBy(*ID).agg(
        at(F.col("syn")).alias("syn_at"),
        F.min_by(F.when(F.col("syn"), F.col("way")), F.when(F.col("syn"), o)).alias("opener"),
        F.count_if(F.col("syn")).alias("syns"),
        at(F.col("rst")).alias("rst_at"),
        F.min_by(F.when(F.col("rst"), F.col("way")), F.when(F.col("rst"), o)).alias("rst_way"),
        at(F.col("payload")).alias("payload_at"),
        at(F.col("fin") & (F.col("way") == 0)).alias("fin0"),
        at(F.col("fin") & (F.col("way") == 1)).alias("fin1"),
        F.count_if(F.col("resent")).alias("resends"),
        F.count_if(F.col("resent") & ~F.col("syn")).alias("other_resends"),
    )
    later = lambda fin, way: F.min(F.when(F.col("payload") & ~F.col("resent") & (F.col("way") == way) & (o > F.col(fin)), o))
    second = frame.where("payload").join(first.select(*ID, "rst_at", "fin0", "fin1"), ID).groupBy(*ID).agg(
        later("fin0", 1).alias("late0"), later("fin1", 0).alias("late1"), F.max(F.when(o < F.col("rst_at"), o)).alias("last_payload")
    )
    c = ends.join(first, ID).join(second, ID, "left")
    reset = F.coalesce(F.col("close").startswith("reset"), F.lit(False))
    refused = F.coalesce((F.col("handshake") == "synObserved") & (F.col("rst_way") != F.col("opener")) & reset, F.lit(False))
    unanswered = (F.col("handshake") == "synObserved") & F.col("close").isNull() & (F.col("phase") == "opening") & (F.col("syns") >= 2)
    aborted = reset & (F.col("payload_at") < F.col("rst_at")) & ~refused
    half = F.col("late0").isNotNull() | F.col("late1").isNotNull()
    use0 = F.col("late0").isNotNull() & (F.col("late1").isNull() | (F.col("fin0") < F.col("fin1")))
    only_syns = (F.col("resends") > 0) & (F.col("other_resends") == 0)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<bigint>")
    cite = lambda cond, name, refs, over: F.when(cond, F.struct(F.lit(name).alias("kind"), refs.alias("refs"), over.alias("supersedes")))
    rules = F.array_compact(
        F.array(
            cite(refused, "connectionRefused", F.array("syn_at", "rst_at"), F.lit("reset")),
            cite(unanswered, "handshakeUnanswered", empty, F.when(only_syns, F.lit("retransmission")).otherwise(none)),
            cite(aborted, "abortAfterData", F.array_distinct(F.array("payload_at", "last_payload", "rst_at")), F.lit("reset")),
            cite(half, "halfClose", F.when(use0, F.array("fin0", "late0")).otherwise(F.array("fin1", "late1")), none),
        )
    )
    found = c.select(*ID, F.explode(rules).alias("r")).select(*ID, F.col("r.kind").alias("kind"), F.col("r.refs").alias("refs"), F.col("r.supersedes").alias("supersedes"))
    syns = _cited(events.where("kind = 'syn'").withColumn("kind", F.lit("handshakeUnanswered")), ID)
    listed = found.join(syns, [*ID, "kind"], "left")
    own = F.size("refs") > 0
    return listed.select(
        *ID,
        "kind",
        F.when(own, F.size("refs").cast("long")).otherwise(F.col("cited")).alias("cited"),
        F.when(own, F.array_min("refs")).otherwise(F.col("first_cited")).alias("first_cited"),
        F.when(own, F.col("refs")).otherwise(F.col("citations")).alias("citations"),
        "supersedes",
    )


def connection_findings(events: DataFrame) -> DataFrame:
    """All findings on connections; a finding that another one explains is left out (anti join)."""
    rules = from_lifecycle(events)
    gone = rules.where("supersedes IS NOT NULL").select(*ID, F.col("supersedes").alias("kind"))
    plain = from_events(events).join(gone, [*ID, "kind"], "left_anti")
    out = plain.unionByName(rules.drop("supersedes"))
    return out.withColumn("severity", severity(F.col("kind")))


def dns_findings(frames: DataFrame) -> DataFrame:
    """Name errors, server failures, and ids asked twice or more without any answer, per session."""
    dns = frames.where("dns_id IS NOT NULL").withColumn("session_id", F.concat_ws("|", "proto", "client_ip", F.col("client_port").cast("string"), "server_ip", F.col("server_port").cast("string")))
    by_code = dns.withColumn("kind", F.when(F.col("rcode") == 3, "dnsNameError").when(F.col("rcode").isin(2, 5), "dnsServerFailure")).where("kind IS NOT NULL")
    asked = dns.groupBy("session_id", "dns_id").agg(F.count_if(~F.col("reply")).alias("asked"), F.count_if(F.col("reply")).alias("answers"))
    silent = asked.where("asked >= 2 AND answers = 0").select("session_id", "dns_id")
    unanswered = dns.where("NOT reply").join(silent, ["session_id", "dns_id"]).withColumn("kind", F.lit("dnsUnanswered"))
    rows = by_code.select("session_id", "kind", "ordinal").unionByName(unanswered.select("session_id", "kind", "ordinal"))
    return _cited(rows, ["session_id"]).withColumn("severity", F.lit(WARNING))


#: ICMP (version, type) and their finding; codes of type 3 with a finding of their own.
ICMP_FINDINGS = {(4, 3): "icmpUnreachable", (4, 11): "icmpTimeExceeded", (6, 1): "icmpUnreachable", (6, 2): "icmpPacketTooBig", (6, 3): "icmpTimeExceeded"}


def icmp_findings(icmp: DataFrame) -> DataFrame:
    """icmp: session_id, ordinal, version, type, code, quoted_session (nullable). The flow that an error quotes
    gets a finding of its own (`icmpReported...`)."""
    kind = F.when((F.col("version") == 4) & (F.col("type") == 3) & (F.col("code") == 4), F.lit("icmpPacketTooBig"))
    for (version, type_), name in ICMP_FINDINGS.items():
        kind = kind.when((F.col("version") == version) & (F.col("type") == type_), F.lit(name))
    named = icmp.withColumn("kind", kind).where("kind IS NOT NULL")
    twin = named.where("quoted_session IS NOT NULL").select(F.col("quoted_session").alias("session_id"), F.regexp_replace("kind", "^icmp", "icmpReported").alias("kind"), "ordinal")
    return _cited(named.select("session_id", "kind", "ordinal").unionByName(twin), ["session_id"]).withColumn("severity", F.lit(WARNING))


def tls_findings(tls: DataFrame) -> DataFrame:
    """tls: session_id, ordinal, way, record (alert, clientHello, serverHello, helloRetry), level, code, version."""
    alert = F.col("record") == "alert"
    kind = (
        F.when(alert & (F.col("level") == 2), "tlsFatalAlert")
        .when(alert & (F.col("level") == 1) & ~F.col("code").isin(0, 90), "tlsWarningAlert")
        .when((F.col("record") == "serverHello") & (F.col("version") < 0x0303), "tlsDeprecatedVersion")
    )
    direct = tls.withColumn("kind", kind).where("kind IS NOT NULL").select("session_id", "kind", "ordinal")
    retry = tls.where("record = 'helloRetry'")
    often = retry.groupBy("session_id", "way").count().where("count >= 2").select("session_id", "way")
    retried = retry.join(often, ["session_id", "way"], "left_semi").select("session_id", F.lit("tlsRepeatedRetryRequest").alias("kind"), "ordinal")
    sides = tls.groupBy("session_id").agg(F.count_if(F.col("record") == "clientHello").alias("c"), F.count_if(F.col("record").isin("serverHello", "helloRetry", "alert")).alias("s"))
    silent = sides.where("c >= 2 AND s = 0").select("session_id")
    mute = tls.where("record = 'clientHello'").join(silent, "session_id", "left_semi").select("session_id", F.lit("tlsHandshakeUnanswered").alias("kind"), "ordinal")
    return _cited(direct.unionByName(retried).unionByName(mute), ["session_id"]).withColumn("severity", F.lit(WARNING))


def capped(findings: DataFrame, most: int) -> DataFrame:
    """The first `most` findings in citation order (a report's length), with the number left out."""
    total = findings.agg(F.count("*").alias("all_"))
    return findings.orderBy("first_cited", "kind").limit(most).crossJoin(F.broadcast(total)).withColumn("omitted", F.greatest(F.col("all_") - most, F.lit(0))).drop("all_")
