"""Activities: a name answer with the connections that it led to, and sessions of one process and name close together.

An answer takes every connection to one of its addresses that begins within the window after it and that no earlier
answer has taken; an answer that was itself taken takes nothing. What depends on what is only the chain of answers whose
own connections dialled an answered address: those few are settled in rounds, from the earliest on, and everything else
is joins and minima. Sessions of unknown start take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.windows import gap_runs
from packetloom.plans.tables import settle


def _facts(sessions: DataFrame) -> DataFrame:
    filled = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    names = F.array_distinct(F.filter(F.array(filled("dns_query"), filled("sni"), filled("http_host")), lambda x: x.rlike(r"\p{L}")))
    return sessions.select(
        "session_id", "start", F.unix_micros(F.col("start").cast("timestamp")).alias("us"), "first_ordinal", F.col("server_ip").alias("address"), filled("process").alias("process"), names.alias("names"),
        F.coalesce(filled("dns_query"), filled("http_host"), filled("sni"), "server_ip").alias("name"), F.array_distinct(F.filter(F.coalesce("dns_answers", F.array().cast("array<string>")), lambda a: a != "")).alias("answers"),
    )


def following_pairs(s: DataFrame, window_us: int) -> DataFrame:
    """(leader, follower) of each answer and each connection to its addresses within the window; slots of the window's
    length are part of the join key, so that a busy address is spread over time."""
    slot = F.floor(F.col("us") / max(1, window_us))
    led = s.where("us IS NOT NULL AND size(answers) > 0").select(F.col("session_id").alias("leader"), F.struct("us", "first_ordinal").alias("leader_key"), F.col("us").alias("led_us"), F.explode("answers").alias("address"), slot.alias("s"))
    led = led.withColumn("slot", F.explode(F.array("s", F.col("s") + 1))).drop("s")
    dialled = s.where("us IS NOT NULL AND address IS NOT NULL").select("session_id", F.struct("us", "first_ordinal").alias("key"), "us", "address", slot.alias("slot"), (F.size("answers") > 0).alias("leads"))
    near = F.col("us").between(F.col("led_us"), F.col("led_us") + window_us) & (F.col("session_id") != F.col("leader"))
    return led.join(dialled, ["address", "slot"]).where(near).select("leader", "leader_key", "session_id", "key", "leads").distinct()


def taken_leaders(pairs: DataFrame) -> DataFrame:
    """Answers that an earlier answer takes (`leader`). Only answers that follow another one are asked; each round settles
    those whose predecessors are settled."""
    edges = settle(pairs.where(F.col("leads") & (F.col("leader_key") < F.col("key"))).select("leader", "session_id"), "edges")
    asked = edges.select("session_id").distinct()
    known = settle(edges.select("leader").join(asked, F.col("leader") == F.col("session_id"), "left_anti").distinct().select("leader", F.lit(False).alias("taken")), "settled")
    while True:
        open_ = asked.join(known, F.col("session_id") == F.col("leader"), "left_anti")
        left = open_.join(edges, "session_id").join(known, "leader", "left")
        now = left.groupBy("session_id").agg(F.max(~F.col("taken")).alias("any"), F.count(F.when(F.col("taken").isNull(), 1)).alias("unknown"))
        now = settle(now.where(F.coalesce("any", F.lit(False)) | (F.col("unknown") == 0)).select(F.col("session_id").alias("leader"), F.coalesce("any", F.lit(False)).alias("taken")), "settled")
        if now.isEmpty():
            return known.where("taken").select("leader")
        known = settle(known.unionByName(now), "settled")


def members(sessions: DataFrame, window_seconds: float = 30, adjacency_seconds: float = 2) -> DataFrame:
    """(session_id, activity_id, kind) of the sessions in an activity: kind dns, led by the answer that names the
    activity, or identity, named by its first session."""
    s = _facts(sessions)
    pairs = settle(following_pairs(s, int(window_seconds * 1_000_000)), "pairs")
    pairs = pairs.join(taken_leaders(pairs), "leader", "left_anti")
    first = lambda p: p.groupBy("session_id").agg(F.min(F.struct("leader_key", "leader")).alias("m")).select("session_id", F.col("m.leader").alias("activity_id"))
    later = F.col("leader_key") < F.col("key")
    # Of equal starts an answer can take one that stands before it, unless that one has taken something itself.
    leading = first(pairs.where(later)).select(F.col("activity_id").alias("session_id")).distinct()
    followers = first(pairs.where(later).unionByName(pairs.where(~later).join(leading, "session_id", "left_anti")))
    followers = settle(followers, "followers")
    dns = followers.unionByName(followers.select(F.col("activity_id").alias("session_id"), "activity_id").distinct()).withColumn("kind", F.lit("dns"))
    rest = s.where((F.size("names") == 1) & F.col("process").isNotNull() & F.col("us").isNotNull()).join(dns.select("session_id"), "session_id", "left_anti")
    key = ["process", "name_"]
    runs = gap_runs(rest.withColumn("name_", F.get("names", F.lit(0))), key, adjacency_seconds)
    named = runs.groupBy(*key, "run").agg(F.min_by("session_id", F.struct("us", "first_ordinal")).alias("activity_id"), F.count("*").alias("n")).where("n > 1")
    return dns.unionByName(runs.join(named, [*key, "run"]).select("session_id", "activity_id", F.lit("identity").alias("kind")))


def activities(sessions: DataFrame, window_seconds: float = 30, adjacency_seconds: float = 2) -> DataFrame:
    """One row per activity: its sessions, first start, name, the process and name that all its sessions share, the other
    names that were answered with its addresses (competing), and the confidence: causal for an answer's connections,
    strong for agreeing process and name, weak where the address is contested."""
    s = _facts(sessions)
    rows = settle(members(sessions, window_seconds, adjacency_seconds), "members")
    one = lambda low, high: F.when(low == high, low)
    g = rows.join(s, "session_id").groupBy("activity_id", "kind").agg(
        F.count("*").alias("sessions"), F.min("start").alias("start"), one(F.min("process"), F.max("process")).alias("process"), one(F.min(F.array_min("names")), F.max(F.array_max("names"))).alias("canonical"),
        F.max(F.when(F.col("session_id") == F.col("activity_id"), F.col("name"))).alias("name"), F.max(F.when((F.col("session_id") == F.col("activity_id")) & (F.col("kind") == "dns"), F.col("answers"))).alias("answers"),
    )
    claims = s.select("name", F.explode("answers").alias("address")).distinct()
    rivals = g.select("activity_id", F.col("name").alias("own"), F.explode("answers").alias("address")).join(claims, "address").where(F.col("name") != F.col("own"))
    rivals = rivals.groupBy("activity_id").agg(F.sort_array(F.collect_set("name")).alias("competing"))
    contested: Column = F.col("competing").isNotNull()
    out = g.join(rivals, "activity_id", "left")
    return out.select("activity_id", "kind", "sessions", "start", "name", "process", "canonical", F.coalesce("competing", F.array().cast("array<string>")).alias("competing"), F.when(contested, "weak").when(F.col("kind") == "dns", "causal").otherwise("strong").alias("confidence"))
