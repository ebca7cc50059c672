"""Operators on hand-built rows, three-valued logic, and batch against stream."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.model import frames_from_events
from packetloom.operators import files, findings, pairing, sessions, stats, timeline
from packetloom.operators import predicates as P
from packetloom.operators import tcp_state
from packetloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def test_scalar_functions(spark):
    texts = ["", "a", "tcp|10.0.0.1|1|192.0.2.1|443", "é漢"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(net.fnv1a64(F.col("t"))).collect()] == [fnv(t) for t in texts]
    ips = spark.createDataFrame([("10.0.0.10",), ("256.1.1.1",), ("1.2.3",), (None,), ("8.8.8.8",), ("::1",)], "ip string")
    got = ips.select(net.ipv4_number(F.col("ip")).alias("n"), net.in_cidr(F.col("ip"), "10.9.9.9/8").alias("c"), net.special_range(F.col("ip")).alias("r")).collect()
    assert [r.n for r in got] == [0x0A00000A, None, None, None, 0x08080808, None]
    assert [r.c for r in got] == [True, False, False, False, False, False]
    assert got[0].r == "private" and got[4].r == "public"
    macs = spark.createDataFrame([("AA-bb-cc-00-11-22",), ("zz",)], "m string")
    assert [r[0] for r in macs.select(net.mac_normalised(F.col("m"))).collect()] == ["aa:bb:cc:00:11:22", None]
    cells = spark.createDataFrame([("=1+1",), ("-5",), ('a"b',), ("@x,y",)], "c string")
    assert [r[0] for r in cells.select(net.csv_cell(F.col("c"))).collect()] == ["'=1+1", "-5", '"a""b"', "\"'@x,y\""]


def test_wildcards(spark):
    df = spark.createDataFrame([("API.Example.COM",), ("a%b",), (None,)], "h string")
    pick = lambda p: [r[0] for r in df.select(P.text_matches("h", p)).collect()]
    assert pick("*.example.com") == [True, False, False]
    assert pick("example") == [False, False, False]
    assert pick("a%b") == [False, True, False]


def test_value_entropy_literals(spark):
    df = spark.createDataFrame([(53,), (53,), (53,), (443,)], "p int")
    rows, one = stats.value_distribution(df, "p")
    assert {r.value: (r.n, r.percent) for r in rows.collect()} == {53: (3, 75.0), 443: (1, 25.0)}
    assert one.first().entropy == pytest.approx(0.8112781244591328)
    assert stats.value_distribution(df.limit(1), "p")[1].first().entropy is None
    assert stats.value_distribution(df.limit(0), "p")[1].first().entropy is None


def test_conversation_literals(spark):
    rows = [
        ("a", "tcp", "10.0.0.5", 50000, "192.0.2.1", 443, 3, 300, 5, 5000, T0, 2.0, 10),
        ("b", "udp", "192.0.2.1", 5353, "10.0.0.5", 5353, 1, 100, 2, 200, T0, 4.0, 11),
    ]
    schema = "session_id string, proto string, client_ip string, client_port int, server_ip string, server_port int, packets_up long, bytes_up long, packets_down long, bytes_down long, start timestamp_ntz, duration double, first_ordinal long"
    r = stats.conversations(spark.createDataFrame(rows, schema), "ipv4").collect()
    assert len(r) == 1
    assert (r[0].address_a, r[0].sessions, r[0].packets_ab, r[0].bytes_ab, r[0].packets_ba, r[0].bytes_ba) == ("10.0.0.5", 2, 5, 500, 6, 5100)


def test_arithmetic_unknown_against_undefined(spark):
    df = spark.createDataFrame([(10, 0, 1, 0), (10, 5, 0, 0), (2**62, 2**62, 1, 1), (10, 5, 1, 1)], "bytes_up long, bytes_down long, packets_up long, packets_down long")
    by_zero = (P.Measure.bytes() // P.Measure.frames("received")).compare(">=", 0)
    assert [r[0] for r in df.select(by_zero).collect()] == [False, None, None, True]
    total = P.Measure.bytes().compare(">=", 1)
    assert [r[0] for r in df.select(total).collect()] == [True, True, None, True]
    assert [r[0] for r in df.select(P.total_bytes(1)).collect()] == [True, True, False, True]


def test_color_rule_stops_at_unknown(spark):
    df = spark.createDataFrame([(None, True), (False, True), (True, True)], "x boolean, y boolean")
    assert [r[0] for r in df.select(P.color([("red", F.col("x")), ("blue", F.col("y"))])).collect()] == ["unknown", "blue", "red"]


def test_rule_builder_has_no_precedence(spark):
    df = spark.createDataFrame([(True, False, False)], "a boolean, b boolean, c boolean")
    chain = P.rule_chain([("", F.col("a")), ("or", F.col("b")), ("and", F.col("c"))])
    assert df.select(chain).first()[0] is False


def test_service_time_literals(spark):
    ms = lambda x: T0 + dt.timedelta(milliseconds=x)
    rows = [(1, 1, ms(0), False, 0), (1, 2, ms(10), True, 0), (2, 3, ms(20), False, 1), (2, 4, ms(40), True, 1), (3, 5, ms(50), False, 1), (3, 6, ms(80), True, 1), (4, 7, ms(90), False, 6), (4, 8, ms(92), True, 6), (4, 9, ms(95), True, 6)]
    df = spark.createDataFrame(rows, "id int, ordinal long, ts timestamp_ntz, reply boolean, command int")
    got = {r.procedure: r for r in pairing.service_times(pairing.pair_once(df, ["id"], ~F.col("reply")), "command").collect()}
    assert (got[0].calls, got[0].least) == (1, 0.01)
    assert (got[1].calls, got[1].least, got[1].most, got[1].average, got[1].total) == (2, 0.02, 0.03, 0.025, 0.05)
    assert (got[6].calls, got[6].total) == (1, 0.002)
    search = spark.createDataFrame([(1, ms(0), False, 0), (2, ms(50), True, 0), (3, ms(60), True, 0), (4, ms(100), True, 1), (5, ms(120), True, 0)], "ordinal long, ts timestamp_ntz, reply boolean, done int").withColumn("id", F.lit(1))
    multi = pairing.pair_until_done(search, ["id"], ~F.col("reply"), F.col("done") == 1).collect()
    assert [r.elapsed_us for r in multi] == [50_000, 60_000, 100_000]


def test_drop_repeats_looks_at_kept_frames_only(spark):
    values = ["a", "a", "b", "c", "d", "e", "f", "a", "f", "a"]
    df = spark.createDataFrame(list(enumerate(values, 1)), "ordinal long, v string")
    kept, out = [], []
    for v in values:
        if v not in kept[-5:]:
            kept.append(v)
            out.append(v)
    assert [r.v for r in files.drop_repeats(df, ["v"]).orderBy("ordinal").collect()] == out


def test_drop_repeats_remembers_over_any_distance(spark):
    rows = [(i, v) for i, v in enumerate("abcde", 1)] + [(i, "e") for i in range(49_700, 50_200)] + [(50_200, "a"), (200_000, "c"), (200_001, "f"), (200_002, "a")]
    df = spark.createDataFrame(rows, "ordinal long, v string").repartition(3)
    kept = [*enumerate("abcde", 1), (200_001, "f"), (200_002, "a")]
    assert [tuple(r) for r in files.drop_repeats(df, ["v"]).orderBy("ordinal").collect()] == kept


def test_dns_lookups_count_every_address(spark, sf_dir):
    one = frames_from_events(spark, sf_dir).where("dns_answer IS NOT NULL AND ts IS NOT NULL").limit(1)
    many = one.drop("ordinal", "dns_answer").crossJoin(spark.range(200).select(F.col("id").alias("ordinal"), F.concat(F.lit("198.51.100."), "id").alias("dns_answer")))
    row = stats.dns_lookups(sessions.fold_sessions(many)).first()
    assert (row.lookups, row.answered, row.addresses) == (1, 1, 200)


def test_merge_refuses_untimed(spark):
    df = spark.createDataFrame([(1, None)], "ordinal long, ts timestamp_ntz")
    with pytest.raises(PySparkException):
        files.merge([df, df]).collect()


def test_axis_planning():
    assert timeline.plan_width(100) == 1
    assert timeline.plan_width(2_000 * 5 + 1) == 10
    assert timeline.plan_width(2_000 * 3_600 * 2) == 7_200


def test_icmp_and_tls_findings(spark):
    icmp = spark.createDataFrame([("s", 1, 4, 3, 1, "q"), ("s", 2, 4, 3, 4, None), ("s", 3, 4, 8, 0, None), ("t", 4, 6, 3, 0, None)], "session_id string, ordinal long, version int, type int, code int, quoted_session string")
    assert {(r.session_id, r.kind) for r in findings.icmp_findings(icmp).collect()} == {("s", "icmpUnreachable"), ("q", "icmpReportedUnreachable"), ("s", "icmpPacketTooBig"), ("t", "icmpTimeExceeded")}
    tls = spark.createDataFrame(
        [("a", 1, 0, "clientHello", None, None, None), ("a", 2, 0, "clientHello", None, None, None), ("b", 3, 1, "helloRetry", None, None, None), ("b", 4, 1, "helloRetry", None, None, None), ("c", 5, 1, "alert", 2, 40, None), ("d", 6, 1, "alert", 1, 0, None), ("e", 7, 1, "serverHello", None, None, 0x0301)],
        "session_id string, ordinal long, way int, record string, level int, code int, version int",
    )
    assert {(r.session_id, r.kind) for r in findings.tls_findings(tls).collect()} == {("a", "tlsHandshakeUnanswered"), ("b", "tlsRepeatedRetryRequest"), ("c", "tlsFatalAlert"), ("e", "tlsDeprecatedVersion")}


def segments(spark, rows):
    full = [(i + 1, "tcp", *( ("10.0.0.1", 1000, "192.0.2.1", 80) if way == 0 else ("192.0.2.1", 80, "10.0.0.1", 1000)), seq, ack, flags, n, 10) for i, (way, seq, ack, flags, n) in enumerate(rows)]
    return spark.createDataFrame(full, "ordinal long, proto string, src_ip string, src_port int, dst_ip string, dst_port int, seq long, ack long, flags int, payload_len long, win_size int")


def kinds_of(spark, rows):
    return {r.kind for r in findings.connection_findings(tcp_state.connection_events(segments(spark, rows))).collect()}


def test_lifecycle_findings(spark):
    assert kinds_of(spark, [(0, 5, None, 2, 0), (1, 0, 6, 20, 0)]) == {"connectionRefused"}
    assert kinds_of(spark, [(0, 5, None, 2, 0), (0, 5, None, 2, 0)]) == {"handshakeUnanswered"}
    assert "abortAfterData" in kinds_of(spark, [(0, 5, 1, 16, 10), (1, 1, 15, 16, 10), (0, 15, 11, 20, 0)])
    assert "reset" not in kinds_of(spark, [(0, 5, 1, 16, 10), (1, 1, 15, 16, 10), (0, 15, 11, 20, 0)])
    assert "halfClose" in kinds_of(spark, [(0, 5, 1, 17, 10), (1, 1, 16, 16, 10)])


def run_stream(spark, stream, name, path, mode="append"):
    """The rows of a stream over all its files, and the state rows that its operators keep after each batch."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).start()
    q.processAllAvailable()
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    return spark.table(name).collect(), kept


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    frames = frames_from_events(spark, sf_dir).orderBy("ordinal")
    source = str(tmp_path / "frames")
    for i in range(3):
        frames.where(F.floor((F.col("ordinal") - 1) / 400) == i).coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    batch = {tuple(r) for r in tcp_state.connection_events(frames).collect()}
    stream = spark.readStream.schema(frames.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(source)
    rows, _ = run_stream(spark, live.connection_events(stream, idle_ms=400 * 86_400_000, lateness="400 days"), "events_out", tmp_path / "c1")
    assert {tuple(r) for r in rows} == batch
    whole = live.timeline(stream, "1 day")
    q = whole.writeStream.format("memory").queryName("timeline_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    days = {r.start: (r.frames, r.bytes) for r in spark.table("timeline_out").collect()}
    expected = frames.where("ts IS NOT NULL").groupBy(F.to_date("ts")).agg(F.count("*").alias("n"), F.sum("orig_len").alias("b")).collect()
    assert sorted(days.values()) == sorted((r.n, r.b) for r in expected)


def test_silent_tuples_lose_their_state(spark, tmp_path):
    at = T0
    syn = lambda i, minutes, port: (i, at + dt.timedelta(minutes=minutes), "tcp", "10.0.0.1", port, "10.0.0.2", 80, 100 + i, None, 2, 0, 10, 60)
    schema = "ordinal long, ts timestamp, proto string, src_ip string, src_port int, dst_ip string, dst_port int, seq long, ack long, flags int, payload_len long, win_size int, orig_len long"
    batches = [[syn(1, 0, 1), syn(2, 0, 2)], [syn(3, 300, 3)], [syn(4, 301, 4)], [syn(5, 302, 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows, kept = run_stream(spark, live.connection_events(stream(), idle_ms=3_600_000, lateness="1 minute"), "expiry_out", tmp_path / "c")
    assert kept[0] == 2 and max(kept) <= 3 and kept[-1] == 3  # the first two tuples go once the watermark has passed them
    again = [r.kind for r in rows if r.ordinal == 5]
    assert sorted(again) == ["firstObserved", "syn"]  # a tuple whose state went starts anew
    rows, kept = run_stream(spark, live.session_totals(stream(), "1 hour", "1 minute"), "totals_out", tmp_path / "t")
    assert kept[-1] <= 3 and sorted((r.packets, r.bytes) for r in rows) == [(1, 60), (1, 60)]


def test_saved_state_goes_on_as_if_never_saved():
    for seed in range(300):
        r = random.Random(seed)
        one, two = tcp_state.TupleState(), tcp_state.TupleState()
        for _ in range(30):
            s = (r.randint(0, 1), r.randint(0, 12), r.choice([None, *range(12)]), r.choice([16, 16, 16, 2, 18, 17, 4]), r.choice([0, 1, 3]), r.choice([0, 5]), r.choice([None, 1]))
            two = tcp_state.restored(tcp_state.saved(two))
            assert one.ingest(*s)[1] == two.ingest(*s)[1]


three = st.sampled_from([True, False, None])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(three, three), min_size=1, max_size=6))
def test_kleene_logic(spark, pairs):
    df = spark.createDataFrame(pairs, "x boolean, y boolean")
    got = df.select((F.col("x") & F.col("y")).alias("a"), (F.col("x") | F.col("y")).alias("o"), (~F.col("x")).alias("n")).collect()
    for (x, y), r in zip(pairs, got, strict=True):
        assert r.a == (False if x is False or y is False else None if x is None or y is None else True)
        assert r.o == (True if x or y else None if x is None or y is None else False)
        assert r.n == (None if x is None else not x)
