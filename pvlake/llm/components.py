"""Connected components by label exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``, the component being its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): every round each node points its
    neighbours to the smallest it knows, in O(log^2 n) rounds at most. A pair is held once, as (larger, smaller): a large star
    puts it at the least neighbour of its smaller node, so a round is two minima per node, combined before the shuffle and
    written, and one distinct. The minima are broadcast up to a counted size; beyond it the joins have exchanges of their
    own that adaptive execution can split: a hub with a third of all edges is no single task. Rounds end once each node has
    one pair, with a node that has none. Each round is written to the shared checkpoint folder; only counts, and what is
    broadcast, reach the driver.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        least = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        above = broadcast_if_small(least.select(F.col("u").alias("v"), F.col("m").alias("over")))
        if least.where("n > 1").isEmpty() and least.select(F.col("m").alias("v")).join(above, "v", "left_semi").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(
                least.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
        large = pairs.join(above, "v", "left").select("u", F.coalesce("over", "v").alias("v"))
        # a node's neighbours, all smaller than itself, and the node go to the least of them
        small = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        pairs = cut_lineage(large.join(broadcast_if_small(small), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")
