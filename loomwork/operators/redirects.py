"""Redirect chains, resolved by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.sources.storage import dropped, staged


def resolved(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, target, hops, is_cycle): where each start's chain ends, however long it is.

    edges: source, target, one for each source at most. Each round joins the chains that still go on with jumps of
    twice the length, and stages both; a chain that goes on after as many hops as there are edges is a
    cycle, and its target is one of the cycle's nodes. Many sources may lead to one target: jumps are keyed by their source, which is unique,
    so only the side of the chains can be skewed, and adaptive execution may split it.
    """
    most = edges.count()
    ends = staged(starts.select("start", F.col("start").alias("target"), F.lit(0).cast("long").alias("hops")), "ends")
    jumps, size = staged(edges.select("source", "target"), "jumps"), 1
    steps = [(jumps, size)]
    while size <= most:
        then = jumps.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        longer = staged(jumps.join(then, "target").select("source", F.col("_next").alias("target")), "jumps")
        if longer.isEmpty():  # no chain is that long
            dropped(longer)
            break
        jumps, size = longer, 2 * size
        steps.append((jumps, size))
    # the longest jump that a chain still has, then the next shorter: the binary digits of its length
    for jump, hops in reversed(steps):
        j = jump.select(F.col("source").alias("target"), F.col("target").alias("_to"))
        more = F.when(F.col("_to").isNotNull(), hops).otherwise(0)
        after = staged(ends.join(j, "target", "left").select("start", F.coalesce("_to", "target").alias("target"), (F.col("hops") + more).alias("hops")), "ends")
        dropped(ends, jump)
        ends = after
    left = edges.select(F.col("source").alias("target"), F.lit(True).alias("_left"))
    return ends.join(left, "target", "left").select("start", "target", "hops", F.coalesce("_left", F.lit(False)).alias("is_cycle"))
