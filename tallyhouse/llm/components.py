"""Connected components of links by alternating stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyhouse.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour instead."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.filter("b > a").join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = (edges.join(least, "a").filter("b <> m")
             .select(F.col("b").alias("a"), F.col("m").alias("b")))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): each linked node with the smallest node it reaches.

    `links` has two columns a and b of comparable ids. Every round is written to the shared
    folder, so lineage stays short; rounds grow with the logarithm of the node count.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    edges = links.filter("a <> b").select(larger.alias("a"), smaller.alias("b")).distinct()
    before, turn = None, 0
    while True:
        seen = Observation()
        edges = scratch.put(f"{name}-{turn}", edges.observe(
            seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")))
        if turn:
            scratch.drop(f"{name}-{turn - 1}")
        now = seen.get
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, turn = now, turn + 1
        edges = _small_star(_large_star(edges))
