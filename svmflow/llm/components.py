"""Connected components of an undirected graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svmflow.llm.common import save
from svmflow.session import Scratch

#: Doublings of the longest path that are followed before the graph counts as broken.
MAX_ROUNDS = 64


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node that an edge ``(a, b)`` names; component is the smallest node.

    Edges with a null end and loops are ignored, repeated edges count once, and
    an empty edge table gives an empty result. Each step groups by node with
    partial aggregation and joins the minimum back, so the neighbours of a hub
    are never gathered; each round is written to the shared folder, among the tables of a run if one is given.
    """
    write = scratch.write if scratch is not None else lambda df: save(df, "links")
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    links = write(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = _state(links)
        if state == before or state[0] == 0:
            return (
                links.select(F.col("a").alias("node"), F.col("b").alias("component"))
                .union(links.select("b", "b"))
                .groupBy("node")
                .agg(F.min("component").alias("component"))
            )
        before = state
        links = write(_small_star(_large_star(links)).distinct())
    raise RuntimeError("components did not settle")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the least of its neighbourhood."""
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    smaller = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", "m"))
