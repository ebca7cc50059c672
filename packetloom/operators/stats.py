"""Statistics over sessions and frames: conversations, endpoints, hierarchies, distributions, tick trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.sessions import LENGTH_BOUNDS


def family(df: DataFrame, kind: str) -> DataFrame:
    """Sessions that a table of this kind covers: ipv4, ipv6, or a transport."""
    if kind in ("tcp", "udp", "sctp"):
        return df.where(F.col("proto") == kind)
    v6 = F.col("client_ip").contains(":")
    return df.where((v6 if kind == "ipv6" else ~v6) & (F.col("proto") != "arp"))


def conversations(sessions: DataFrame, kind: str = "ipv4") -> DataFrame:
    """Unordered endpoint pairs; side A is the client of the pair's first session in first-seen order."""
    ports = kind in ("tcp", "udp", "sctp")
    key = lambda side: F.concat_ws(":", f"{side}_ip", F.col(f"{side}_port").cast("string")) if ports else F.col(f"{side}_ip")
    rows = family(sessions, kind).withColumns({"ck": key("client"), "sk": key("server")})
    rows = rows.withColumns({"lo": F.least("ck", "sk"), "hi": F.greatest("ck", "sk"), "end": F.col("start") + F.make_dt_interval(secs=F.col("duration").cast("decimal(18,6)"))})
    lo_is_client = F.col("ck") == F.col("lo")
    side = lambda up, down: F.sum(F.when(lo_is_client, F.col(up)).otherwise(F.col(down)))
    g = rows.groupBy("lo", "hi").agg(
        F.min_by("ck", "first_ordinal").alias("address_a"),
        F.count("*").alias("sessions"),
        side("packets_up", "packets_down").alias("p_lo"),
        side("bytes_up", "bytes_down").alias("b_lo"),
        side("packets_down", "packets_up").alias("p_hi"),
        side("bytes_down", "bytes_up").alias("b_hi"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min("first_ordinal").alias("first_ordinal"),
    )
    a_is_lo = F.col("address_a") == F.col("lo")
    pick = lambda a, b: F.when(a_is_lo, F.col(a)).otherwise(F.col(b))
    return g.select(
        "address_a",
        F.when(a_is_lo, F.col("hi")).otherwise(F.col("lo")).alias("address_b"),
        "sessions",
        pick("p_lo", "p_hi").alias("packets_ab"),
        pick("b_lo", "b_hi").alias("bytes_ab"),
        pick("p_hi", "p_lo").alias("packets_ba"),
        pick("b_hi", "b_lo").alias("bytes_ba"),
        "start",
        "end",
        "first_ordinal",
    )


def endpoints(sessions: DataFrame, kind: str = "ipv4") -> DataFrame:
    """Both sides of every session; a session counts once for an endpoint."""
    ports = kind in ("tcp", "udp", "sctp")
    side = lambda s, tx, rx: F.struct(
        F.col(f"{s}_ip").alias("ip"),
        (F.col(f"{s}_port") if ports else F.lit(None).cast("int")).alias("port"),
        F.col(f"packets_{tx}").alias("tx_packets"),
        F.col(f"bytes_{tx}").alias("tx_bytes"),
        F.col(f"packets_{rx}").alias("rx_packets"),
        F.col(f"bytes_{rx}").alias("rx_bytes"),
    )
    both = family(sessions, kind).select("session_id", F.explode(F.array(side("client", "up", "down"), side("server", "down", "up"))).alias("e"))
    # Sides of one session that share a key are one row first, so that the session counts once.
    each = both.groupBy("session_id", F.col("e.ip").alias("ip"), F.col("e.port").alias("port")).agg(*[F.sum(f"e.{c}").alias(c) for c in ("tx_packets", "tx_bytes", "rx_packets", "rx_bytes")])
    return each.groupBy("ip", "port").agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("tx_packets", "tx_bytes", "rx_packets", "rx_bytes")])


def packet_lengths(frames: DataFrame) -> DataFrame:
    """Every length range, empty ones too, and a total row (bucket -1)."""
    from packetloom.operators.sessions import length_bucket

    g = frames.select(length_bucket(F.col("orig_len")).alias("bucket"), "orig_len").groupingSets([["bucket"], []], "bucket").agg(
        F.grouping("bucket").alias("is_total"), F.count("*").alias("count"), F.sum("orig_len").alias("total"), F.min("orig_len").alias("least"), F.max("orig_len").alias("most")
    )
    counted = g.select(F.when(F.col("is_total") == 1, -1).otherwise(F.col("bucket")).alias("bucket"), "count", "total", "least", "most")
    every = frames.sparkSession.range(-1, len(LENGTH_BOUNDS)).select(F.col("id").cast("int").alias("bucket"))
    out = every.join(counted, "bucket", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    everything = F.max(F.when(F.col("bucket") == -1, F.col("count"))).over(Window.partitionBy())
    return out.select("bucket", "count", "least", "most", F.try_divide(F.col("total"), F.col("count")).alias("average"), F.try_divide(F.lit(100.0) * F.col("count"), everything).alias("percent"))


def protocol_hierarchy(sessions: DataFrame, depth: int = 8) -> DataFrame:
    """All prefixes of the protocol stacks: sessions, bytes and the sessions that end there."""
    stack = F.slice("stack", 1, depth)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(stack)), lambda n: F.struct(F.array_join(F.slice(stack, 1, n), "/").alias("path"), (n == F.size(stack)).alias("ends")))
    long = sessions.where(F.size("stack") > 0).select("bytes", F.explode(prefixes).alias("p"))
    return long.groupBy(F.col("p.path").alias("path")).agg(F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("p.ends"), 1).otherwise(0)).alias("ending"))


def dns_lookups(sessions: DataFrame) -> DataFrame:
    """Per folded name: lookups, answered, failures, distinct addresses and the (interpolated) median response."""
    dns = sessions.where(F.array_contains("stack", "dns") & F.col("dns_query").isNotNull() & (F.trim("dns_query") != ""))
    named = dns.withColumn("name_key", F.lower(F.trim("dns_query")))
    spell = named.groupBy("name_key", F.trim("dns_query").alias("spelling")).agg(F.count("*").alias("n"))
    best = spell.groupBy("name_key").agg(F.min_by("spelling", F.struct(-F.col("n"), "spelling")).alias("name"))
    addresses = named.select("name_key", F.explode("dns_answers").alias("address")).groupBy("name_key").agg(F.count_distinct("address").alias("addresses"))
    main = named.groupBy("name_key").agg(
        F.count("*").alias("lookups"), F.sum(F.when(F.col("n_answers") > 0, 1).otherwise(0)).alias("answered"), F.median(F.col("latency_ms")).alias("median_ms")
    )
    return main.join(best, "name_key").join(addresses, "name_key", "left").select("name", "lookups", "answered", F.coalesce("addresses", F.lit(0)).cast("long").alias("addresses"), "median_ms")


def message_counts(tally: DataFrame) -> DataFrame:
    """Methods, status classes and codes: messages and sessions, as a two-level rollup."""
    group = F.when(F.col("kind") == "method", F.lit("requests")).otherwise(F.concat(F.substring("key", 1, 1), F.lit("xx")))
    rows = tally.select("proto", "a", "b", "kind", group.alias("class"), "key", "messages")
    # Sessions are counted from one row per session, class and key, so no distinct is needed on the way down.
    per_key = rows.groupBy("class", "key").agg(F.sum("messages").alias("messages"), F.count("*").alias("sessions"))
    per_class = rows.groupBy("class", "proto", "a", "b").agg(F.sum("messages").alias("m")).groupBy("class").agg(F.sum("m").alias("messages"), F.count("*").alias("sessions"))
    return per_key.unionByName(per_class.withColumn("key", F.lit(None).cast("string")))


def groups(sessions: DataFrame, by: str) -> DataFrame:
    """Sessions grouped by an observed attribute: worst status, first-seen stack, totals."""
    return sessions.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("group")).agg(
        F.count("*").alias("sessions"),
        F.sum("bytes").alias("bytes"),
        F.max(F.when(F.col("status") == "error", 1).otherwise(0)).alias("worst"),
        F.array_join(F.min_by("stack", "first_ordinal"), "/").alias("first_stack"),
        F.min("start").alias("start"),
    )


def response_times(measured: DataFrame, by: str) -> DataFrame:
    """count, fastest, lower median and slowest of `elapsed`, with the slowest's session (earliest of equals)."""
    return measured.where("elapsed IS NOT NULL").groupBy(by).agg(
        F.count("*").alias("n"),
        F.min("elapsed").alias("fastest"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY elapsed)").alias("lower_median"),
        F.max("elapsed").alias("slowest"),
        F.min_by("session_id", F.struct(-F.col("elapsed"), "first_ordinal")).alias("slowest_session"),
    )


def value_distribution(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(value, n, percent) and one row with the number of values and the normalised entropy, null below two values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    share = counts.crossJoin(F.broadcast(total))
    rows = share.select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))
    p = F.col("n") / F.col("total")
    one = share.agg(F.count("*").alias("values"), F.coalesce(F.max("total"), F.lit(0)).alias("rows"), (-F.sum(p * F.log2(p))).alias("bits"))
    return rows, one.select("values", "rows", F.when(F.col("values") >= 2, F.col("bits") / F.log2(F.col("values").cast("double"))).alias("entropy"))


def resolved_addresses(frames: DataFrame) -> DataFrame:
    """(address, name) pairs seen in answers; others: whether the address has further names."""
    pairs = frames.where("dns_answer IS NOT NULL").groupBy(F.col("dns_answer").alias("address"), F.lower("dns_name").alias("name")).agg(F.count("*").alias("seen"), F.min("ordinal").alias("first_ordinal"))
    return pairs.withColumn("others", F.count("*").over(Window.partitionBy("address")) > 1)


#: Ports that name an encrypted DNS transport.
ENCRYPTED_DNS = {("tcp", 853): "DoT", ("udp", 853): "DoQ", ("tcp", 8443): "DoH"}


def encrypted_dns(sessions: DataFrame, ports: dict[tuple[str, int], str] = ENCRYPTED_DNS) -> DataFrame:
    kind = F.lit(None).cast("string")
    for (proto, port), name in ports.items():
        kind = F.when((F.col("proto") == proto) & (F.col("server_port") == port), F.lit(name)).otherwise(kind)
    found = sessions.withColumn("kind", kind).where("kind IS NOT NULL")
    return found.groupBy("kind", "server_ip").agg(F.count("*").alias("sessions"), F.sum("bytes").alias("bytes"))


def tick_tree(df: DataFrame, levels: Sequence[str], measure: str | None = None) -> DataFrame:
    """A counted tree over the given columns: ROLLUP, with depth and (if asked) average, least and most."""
    named = df.select(*[F.col(c).cast("string").alias(c) for c in levels], *([measure] if measure else []))
    aggs = [F.count("*").alias("ticks")] + ([F.avg(measure).alias("average"), F.min(measure).alias("least"), F.max(measure).alias("most")] if measure else [])
    rolled = named.rollup(*levels).agg(F.grouping_id().alias("gid"), *aggs)
    depth = sum((F.lit(1) - F.col("gid").bitwiseAND(1 << i) / F.lit(1 << i) for i in range(len(levels))), F.lit(0))
    return rolled.withColumn("depth", depth.cast("int")).drop("gid")


def top_children(df: DataFrame, parent: str, child: str, keep: int) -> DataFrame:
    """The `keep` most frequent children of each parent (ties: larger name first); the rest as one `Other` row."""
    counts = df.groupBy(parent, child).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("n"), F.desc(child)))
    named = counts.withColumn("label", F.when(rank <= keep, F.col(child)).otherwise(F.lit("Other")))
    return named.groupBy(parent, "label").agg(F.sum("n").alias("n"))


def findings_summary(findings: DataFrame, floor: int = 0) -> DataFrame:
    """Per kind, worst first: findings, sessions and cited frames. Severity: 0 note, 1 warning."""
    g = findings.where(F.col("severity") >= floor).groupBy("kind").agg(
        F.max("severity").alias("severity"), F.count("*").alias("findings"), F.count_distinct("session_id").alias("sessions"), F.sum("cited").alias("cited")
    )
    return g.orderBy(F.desc("severity"), F.desc("findings"), "kind")


def fidelity(frames: DataFrame, dropped: Column) -> DataFrame:
    """received / offered, and whether more than 0.5 % was lost."""
    one = frames.agg(F.count("*").alias("received"), F.sum(dropped).alias("dropped"))
    ratio = F.try_divide(F.col("received"), F.col("received") + F.col("dropped"))
    return one.select("received", "dropped", ratio.alias("fidelity"), (ratio < 0.995).alias("lossy"))
