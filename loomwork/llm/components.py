"""Connected components of an edge table, by alternating large-star and small-star steps.

Each node's least neighbour is a grouped minimum with partial aggregates, staged before it joins the edges
again, so a hub's edges can be split over tasks. Rounds grow with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import small, stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v. Large: greater neighbours of a node to the least of it and its neighbours; small: lesser ones, and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")), "least")
    met = both.join(small(least), "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = met.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    out = stage(out.distinct(), "star")
    unstage(least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge that isn't the least of its component, that least node."""
    edges = stage(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    last = sign(edges)
    while last[0]:
        large = _star(edges, True)
        small_ = _star(large, False)
        unstage(edges, large)
        edges, now = small_, sign(small_)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
