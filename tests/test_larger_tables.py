"""What the small tables don't hold: long runs of lost pieces, and more users than addresses of two numbers name."""

import random
from collections import deque
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import rows_of

from packetloom.operators import files
from packetloom.queries import ORACLES, QUERIES


def events(spark, path, rows):
    """rows: event_id, user_id, event_type, k."""
    start = datetime(2024, 1, 1)
    made = [(e, start + timedelta(seconds=e), user, kind, 30.0, f'{{"k": {k}}}') for e, user, kind, k in rows]
    df = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.mode("overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def assert_as_sql(spark, path, name):
    df = QUERIES[name](spark, path)
    columns = sorted(df.columns)
    got = rows_of(columns, [r.asDict() for r in df.collect()])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = rows_of(columns, [dict(zip(names, r, strict=True)) for r in result.fetchall()])
    assert want and got == want


def test_tcp_health_where_several_pieces_in_a_row_are_lost(spark, tmp_path):
    ordinals = [1, 3, 14, 25, 36, 37, 38, 39, 40, 41, 42]
    assert_as_sql(spark, events(spark, tmp_path, [(o - 1, 1, "view", 2) for o in ordinals]), "tcp_health")


#: More users than 10.0.0.0/16 has addresses, and more than 10.0.0.0/8 has.
MANY = [1, 200, 300, 65_535, 65_536, 70_001, 90_255, 17_000_000]


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    kinds = ["view", "click", "view", "purchase", "error", "signup"]
    rows = [(i, MANY[i % len(MANY)], kinds[i // len(MANY) % len(kinds)], i * 7 % 100) for i in range(len(MANY) * 60)]
    return events(spark, tmp_path_factory.mktemp("many"), rows)


@pytest.mark.parametrize("name", ["address_functions", "captured_sessions", "rtp_streams", "subnet_names", "subnets", "tcp_health", "tls_findings", "split_hellos", "tunnelled_frames"])
def test_more_users_than_addresses_of_two_numbers(spark, many_users, name):
    assert_as_sql(spark, many_users, name)


#: Contents at random, few of them, all the same, and in a step that lets a block's end depend on its start for ever.
STREAMS = {"random": lambda r, i: r.randrange(50), "few": lambda r, i: r.randrange(7), "same": lambda r, i: 1, "in step": lambda r, i: 5 - i if i < 5 else (i - 5) % 6, "null": lambda r, i: None if i % 3 else i}


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_drop_repeats_in_blocks_keeps_what_one_pass_keeps(spark, kind):
    r = random.Random(3)
    rows = [(i * 3 + 1, STREAMS[kind](r, i)) for i in range(700)]
    kept, last = [], deque(maxlen=5)
    for o, v in rows:
        if v not in last:
            last.append(v)
            kept.append((o, v))
    mixed = spark.createDataFrame(r.sample(rows, len(rows)), "ordinal long, v int")
    out = files.drop_repeats(mixed, ["v"], block=250)
    assert sorted((x.ordinal, x.v) for x in out.collect()) == kept


def test_drop_repeats_sorts_no_whole_table_in_one_task(spark):
    df = spark.range(2_000).select((F.col("id") + 1).alias("ordinal"), (F.col("id") % 90).alias("v"))
    out = files.drop_repeats(df, ["v"], block=200)
    sizes = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(x["count"] for x in sizes) == 2_000 and max(x["count"] for x in sizes) < 1_500


def test_tcp_health_makes_its_segments_in_one_pass_and_keeps_what_is_read(spark, sf_dir, monkeypatch, capsys):
    from packetloom import queries

    seen, real = {}, queries.settle

    def settle(df, label, **kw):
        df.explain()
        seen[label] = (df.columns, capsys.readouterr().out)
        return real(df, label, **kw)

    monkeypatch.setattr(queries, "settle", settle)
    before = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    QUERIES["tcp_health"](spark, sf_dir)
    assert seen["written"][1].count("FileScan parquet") == 1 and seen["written"][1].count("Exchange") == 1
    assert len(seen["decoded"][0]) == 11 and "bytes" not in seen["decoded"][0]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == before
