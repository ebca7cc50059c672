"""Activities against a plain walk in time order; files split by time against the rule frame by frame; filter terms."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from packetloom.operators import activities as A
from packetloom.operators import listing

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session_id string, start timestamp, first_ordinal long, server_ip string, process string, dns_query string, sni string, http_host string, dns_answers array<string>"


def walk(rows, window, gap):
    """session_id -> (activity, kind), and per activity (names that compete)."""
    ordered = sorted((r for r in rows if r["start"]), key=lambda r: (r["start"], r["first_ordinal"]))
    name = lambda r: r["dns_query"] or r["http_host"] or r["sni"] or r["server_ip"]
    names = lambda r: {x for x in (r["dns_query"], r["sni"], r["http_host"]) if x and re.search("[A-Za-z]", x)}
    out, rivals = {}, {}
    for lead in ordered:
        if not lead["dns_answers"] or lead["session_id"] in out:
            continue
        late = [c for c in ordered if c["server_ip"] in lead["dns_answers"] and c is not lead and c["session_id"] not in out and 0 <= (c["start"] - lead["start"]).total_seconds() <= window]
        for c in [lead, *late] if late else []:
            out[c["session_id"]] = (lead["session_id"], "dns")
        if late:
            rivals[lead["session_id"]] = sorted({name(r) for r in rows if set(r["dns_answers"] or ()) & set(lead["dns_answers"])} - {name(lead)})
    runs = {}
    for r in ordered:
        if r["session_id"] not in out and r["process"] and len(names(r)) == 1:
            known = runs.setdefault((r["process"], min(names(r))), [[]])
            if known[-1] and (r["start"] - known[-1][-1]["start"]).total_seconds() > gap:
                known.append([])
            known[-1].append(r)
    for run in (x for known in runs.values() for x in known if len(x) > 1):
        out |= {r["session_id"]: (run[0]["session_id"], "identity") for r in run}
    return out, rivals


@pytest.mark.parametrize("seed", range(2))
def test_activities_against_a_walk(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        answers = r.choice([None, None, ["10.0.0.1"], ["10.0.0.2", "10.0.0.3"], ["10.0.0.4", "10.0.0.4"]])
        start = None if r.random() < 0.05 else T0 + dt.timedelta(seconds=r.randint(0, 900))
        rows.append({"session_id": f"s{i:03}", "start": start, "first_ordinal": i, "server_ip": f"10.0.0.{r.randint(1, 9)}", "process": r.choice([None, "p", "q"]), "dns_query": r.choice(["a.example", "b.example"]) if answers else None, "sni": None if answers else r.choice([None, "c.example"]), "http_host": None, "dns_answers": answers})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SCHEMA)
    want, rivals = walk(rows, 60, 20)
    assert any(v == (k, "dns") for k, v in want.items())
    assert {x.session_id: (x.activity_id, x.kind) for x in A.members(df, 60, 20).collect()} == want
    for x in A.activities(df, 60, 20).collect():
        assert x.sessions == sum(v[0] == x.activity_id for v in want.values())
        assert (x.competing, x.confidence) == (rivals.get(x.activity_id, []) if x.kind == "dns" else [], "strong" if x.kind == "identity" else "weak" if rivals[x.activity_id] else "causal")
    assert A.activities(df.limit(0)).count() == 0


def test_an_answer_that_was_taken_takes_nothing(spark):
    # Each answer's own connection dials the address of the answer before: every second one is taken.
    rows = [(f"s{i}", T0 + dt.timedelta(seconds=i), i, f"10.0.0.{i}", None, f"n{i}.example", None, None, [f"10.0.0.{i + 1}"]) for i in range(1, 10)]
    got = {x.session_id: x.activity_id for x in A.members(spark.createDataFrame(rows, SCHEMA), 5, 1).collect()}
    assert got == {f"s{i}": f"s{i - (i + 1) % 2}" for i in range(1, 9)}


@pytest.mark.parametrize("seed", range(2))
def test_split_by_seconds(spark, seed):
    r = random.Random(seed)
    at, times = 0, []
    for _ in range(300):
        at += r.choice([0, 0, 1, 2, 3, -4, 40 if r.random() < 0.05 else 1])
        times.append(max(0, at))
    file, start, want = -1, None, []
    for t in times:
        if start is None or t - start >= 10:
            file, start = file + 1, t
        want.append(file)
    df = spark.createDataFrame([(i * 700, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "ordinal long, ts timestamp").repartition(7)
    for rows in (1_000_000, 9):  # one block, and many
        assert [x.file for x in listing.split_by_seconds(df, 10, rows).orderBy("ordinal").collect()] == want


def test_split_refuses_untimed_frames(spark):
    df = spark.createDataFrame([(1, T0), (2, None)], "ordinal long, ts timestamp")
    with pytest.raises(ValueError, match="without a time"):
        listing.split_by_seconds(df, 10)
    assert listing.split_by_seconds(df.limit(0), 10).count() == 0
    told = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 8, 12, 21])], "ordinal long, ts timestamp")
    assert [x.file for x in listing.split_by_seconds(told, 10).orderBy("ordinal").collect()] == [0, 0, 1, 1]


def test_terms_and_tree_order(spark):
    rows = [("x", "tcp", "10.0.0.1", 5, "10.0.0.2", 80, "02:00", "04:00"), ("y", "udp", "fe80:0:0:0:0:0:0:1", 53, "fe80:0:0:0:0:0:0:2", 53, None, None), ("z", "icmp", "10.0.0.1", 0, "10.0.0.2", 0, None, None)]
    df = spark.createDataFrame(rows, "session_id string, proto string, client_ip string, client_port int, server_ip string, server_port int, client_mac string, server_mac string")
    got = {(r.session_id, r.layer): r.term for r in listing.conversation_terms(df).collect()}
    pair = "ip == 10.0.0.1 and ip == 10.0.0.2"
    assert got == {
        ("x", "Ethernet"): "mac == 02:00 and mac == 04:00", ("x", "IPv4"): pair, ("x", "TCP"): f"tcp and {pair} and port == 5 and port == 80", ("z", "IPv4"): pair,
        ("y", "IPv6"): "ip == fe80:0:0:0:0:0:0:1 and ip == fe80:0:0:0:0:0:0:2", ("y", "UDP"): "udp and ip == fe80:0:0:0:0:0:0:1 and ip == fe80:0:0:0:0:0:0:2 and port == 53",
    }
    nodes = spark.createDataFrame([("a", 2), ("b", 2), ("c", 3)], "name string, count long")
    assert [r.name for r in listing.tree_order(nodes).collect()] == ["c", "b", "a"]
    assert listing.conversation_terms(df.drop("client_mac")).where(F.col("layer") == "Ethernet").count() == 0
