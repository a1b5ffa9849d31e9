"""Connected components by alternating large-star and small-star steps.

Edges stay in DataFrames: nothing is collected but two counters per round. A
step links every neighbour of a node to the smallest node around it, so a
component turns into a star around its smallest node in a logarithmic number of
rounds. A hot node is no hot group: the smallest neighbour is a partial
(map-side) aggregate, and the join that brings it back to the node's edges is a
sort-merge join whose large partitions adaptive execution splits.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step, as rows (a > b)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (both.join(least, "u").where("v > u")
             .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(low, "a")
    return (joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b"))).where("a > b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) -> (node, component): each node that is not the
    smallest of its component, with the smallest.

    Self links, repeated links and null ends are dropped; an empty table gives
    an empty result. Each round is written to the shared folder; rounds end
    when a round changes nothing (row count and order-free checksum).
    """
    now = materialise(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, now = mark, materialise(_star(now), "star")
