"""Times the headline queries once each after a warm-up and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "sessions", "conv_ipv4", "endpoints_tcp", "protocol_hierarchy", "dns_lookups", "http_counts", "ip_tree", "filter_arithmetic", "color_rules",
    "frame_deltas", "cumulative_bytes", "relative_sequence", "timeline_filled", "graph_comparison", "request_pairs", "service_times", "answer_to_connection",
    "connection_events", "connection_findings", "dns_findings", "anonymise", "subnet_names",
]


def lone_syns(spark: SparkSession, n: int):
    """The connection fold over n unanswered SYNs of different tuples."""
    from pyspark.sql import functions as F

    from packetloom.operators.tcp_state import connection_events

    i = F.col("id")
    return connection_events(
        spark.range(n).select(
            (i + 1).alias("ordinal"), F.lit("tcp").alias("proto"), F.concat_ws(".", F.lit("10"), *[(F.floor(i / 256**k) % 256).cast("string") for k in (2, 1, 0)]).alias("src_ip"),
            F.lit(50_000).alias("src_port"), F.lit("192.0.2.1").alias("dst_ip"), F.lit(443).alias("dst_port"), (i * 7).alias("seq"), F.lit(None).cast("long").alias("ack"),
            F.lit(2).alias("flags"), F.lit(0).cast("long").alias("payload_len"), F.lit(1000).alias("win_size"),
        )
    )


def wildcards(spark: SparkSession):
    """The worst case of wildcard matching: 50 texts of 250 letters against 60 times `*a`, then a letter that is not there."""
    from pyspark.sql import functions as F

    from packetloom.functions import net

    return spark.range(50).select(net.wildcard(F.repeat(F.lit("a"), 250), "*a" * 60 + "b").alias("hit"))


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from packetloom.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: (lambda n=name: QUERIES[n](spark, sf_dir)) for name in HEADLINE}
    runs |= {f"lone_syns_{n}": (lambda n=n: lone_syns(spark, n)) for n in (40_000, 80_000)}
    runs["wildcards_50"] = lambda: wildcards(spark)
    took = {}
    for name, make in runs.items():
        for _ in range(2):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of headline queries, second run", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
