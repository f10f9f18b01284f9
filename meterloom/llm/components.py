"""Connected components of a graph that no single task can hold.

Alternating star contraction: every node hands its neighbours to the smallest node it knows, first to larger
neighbours and then to smaller ones, until each component is a star around its smallest node. Each half step is
one aggregation with map-side minima and one equi-join; edges shrink towards one per node. Every round is written
to the shared folder, so a lost executor repeats at most one round, and both sides of the join over star centres
are stored tables, whose hot centres adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _larger(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    smallest = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    moved = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(smallest, "a")
    linked = moved.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(smallest.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """For links ``(a, b)`` between 64-bit nodes, rows ``(node, root)`` of every linked node but the roots.

    Direction and repetition of links don't matter; links from a node to itself are ignored. ``root`` is the
    smallest node of the component. No links give no rows.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _mark(edges)
    while True:
        edges = cut_lineage(_smaller(cut_lineage(_larger(edges))))
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
