"""Joins of one event with an earlier one: requests and replies, answers and connections, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.net import cidr_bounds, ipv4_number, network_of

#: Networks that are sent to every executor: a million take about 130 MB.
BROADCAST_NETWORKS = 1_000_000


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def pair_once(messages: DataFrame, key: list[str], is_request: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Replies with the latest open request of their key before them; a reply closes the request (consume-once).

    Within a key a reply pairs iff the message just before it is a request: a second request replaces the first,
    and after a reply nothing is open. So one lag over the key's order says it all."""
    order = Window.partitionBy(*key).orderBy("ordinal")
    marked = messages.withColumn("req_", is_request)
    back = {f"request_{c}": F.lag(c).over(order) for c in ("ordinal", "ts", *carry)}
    rows = marked.withColumns({**back, "open_": F.lag("req_").over(order)})
    return rows.where(~F.col("req_") & F.coalesce("open_", F.lit(False))).withColumn("elapsed_us", micros("ts") - micros("request_ts")).drop("req_", "open_")


def pair_until_done(messages: DataFrame, key: list[str], is_request: Column, is_done: Column) -> DataFrame:
    """Every reply pairs with the latest request before it, until a done reply (which pairs too) closes it."""
    order = Window.partitionBy(*key).orderBy("ordinal")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumns({"req_": is_request, "done_": ~is_request & is_done})
    rows = rows.withColumns({"request_ordinal": F.last(F.when(F.col("req_"), F.col("ordinal")), ignorenulls=True).over(upto), "request_ts": F.last(F.when(F.col("req_"), F.col("ts")), ignorenulls=True).over(upto), "closed_": F.max(F.when(F.col("done_"), F.col("ordinal"))).over(before)})
    open_ = ~F.col("req_") & F.col("request_ordinal").isNotNull() & (F.coalesce("closed_", F.lit(-1)) < F.col("request_ordinal"))
    return rows.where(open_).withColumn("elapsed_us", micros("ts") - micros("request_ts")).drop("req_", "done_", "closed_")


def service_times(pairs: DataFrame, procedure: str) -> DataFrame:
    """Per procedure: calls, least, most, average and summed seconds, from whole microseconds."""
    s = F.col("elapsed_us") / 1e6
    return pairs.where("elapsed_us IS NOT NULL").groupBy(F.col(procedure).alias("procedure")).agg(F.count("*").alias("calls"), F.min(s).alias("least"), F.max(s).alias("most"), (F.sum("elapsed_us") / F.count("*") / 1e6).alias("average"), (F.sum("elapsed_us") / 1e6).alias("total"))


def echo_summary(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """Requests, replies, losses, and the statistics of the response times in milliseconds (deviation 0 for one)."""
    sent = requests.agg(F.count("*").alias("requests"))
    ms = F.col("elapsed_us") / 1e3
    got = pairs.agg(
        F.count("*").alias("replies"), F.min(ms).alias("least"), F.max(ms).alias("most"), F.avg(ms).alias("mean"), F.median(ms).alias("median"),
        F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.stddev_samp(ms)).alias("deviation"),
        F.min_by("ordinal", F.struct("elapsed_us", "ordinal")).alias("least_ordinal"), F.min_by("ordinal", F.struct(-F.col("elapsed_us"), "ordinal")).alias("most_ordinal"),
    )
    return sent.crossJoin(F.broadcast(got)).withColumns({"lost": F.col("requests") - F.col("replies"), "loss_percent": F.try_divide(100.0 * (F.col("requests") - F.col("replies")), F.col("requests"))})


def following(answers: DataFrame, connections: DataFrame, window_seconds: int = 30) -> DataFrame:
    """Connections to an answered address that start 0 to window_seconds after the answer (an equi-join on the
    address and the time slot, so that a popular address is spread over its slots)."""
    width = window_seconds * 1_000_000
    left = answers.select("address", "name", F.col("ordinal").alias("answer_ordinal"), micros("ts").alias("answer_us"))
    left = left.withColumn("slot", F.explode(F.array(F.floor(F.col("answer_us") / width), F.floor(F.col("answer_us") / width) + 1)))
    right = connections.where("start IS NOT NULL").select("session_id", F.col("server_ip").alias("address"), micros("start").alias("start_us")).withColumn("slot", F.floor(F.col("start_us") / width))
    return left.join(right, ["address", "slot"]).where((F.col("start_us") >= F.col("answer_us")) & (F.col("start_us") - F.col("answer_us") <= width)).select("address", "name", "answer_ordinal", "session_id", (F.col("start_us") - F.col("answer_us")).alias("after_us"))


def longest_prefix(rows: DataFrame, ip_col: str, networks: dict[str, str], out: str = "network") -> DataFrame:
    """The name of the narrowest network that holds the address: one equi-join on (width, masked), broadcast up to
    BROADCAST_NETWORKS of them."""
    table = [(int(c.partition("/")[2] or 32), cidr_bounds(c)[0], name) for c, name in networks.items()]
    names = rows.sparkSession.createDataFrame(table, "bits int, net long, name string")
    widths = sorted({b for b, _, _ in table})
    distinct = rows.select(F.col(ip_col).alias("ip_")).distinct().withColumn("n_", ipv4_number(F.col("ip_"))).where("n_ IS NOT NULL")
    keys = distinct.select("ip_", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), network_of(F.col("n_"), b).alias("net")) for b in widths])).alias("k"))
    hit = keys.select("ip_", "k.bits", "k.net").join(F.broadcast(names) if len(table) <= BROADCAST_NETWORKS else names, ["bits", "net"]).groupBy("ip_").agg(F.max_by("name", "bits").alias(out))
    return rows.join(hit, rows[ip_col] == hit["ip_"], "left").drop("ip_")
