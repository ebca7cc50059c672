"""Connected components of a link table by alternating large-star and small-star steps.

The label of a component is its smallest node. Every step is a grouped minimum and an equi-join, so a hub
with very many links is combined before the shuffle and its join can be split; few minima, counted, are sent to all
tasks instead. Each step's edges are written to the shared folder; the loop ends when a full step changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import materialize, small


def _sum(edges: DataFrame) -> tuple:
    """Number of edges and a checksum of them, which tell whether a step changed anything."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(small(least, 2 * n), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(small(least, n), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: columns a, b. Returns (node, component) for every node but those that are their component's
    smallest; self links and repeated links are allowed; an empty table gives an empty result."""
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(start, "links")
    before = _sum(edges)
    while before[0]:
        stars = materialize(_large_star(edges, before[0]), "stars")
        edges = materialize(_small_star(stars, before[0]), "links")
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
