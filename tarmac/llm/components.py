"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut


ROWS = 100_000   # edges in a partition


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of the
    undirected ``edges`` (a, b), both long and not null.

    Each round points a node's larger neighbours, then its smaller ones, at
    its least neighbour, until only stars are left; the number of rounds grows
    with the logarithm of the longest chain. A node with very many edges is a
    skewed join key (split by AQE) beside a table of one row per node. An
    empty edge table has no nodes.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
        # a few edges need few tasks: partitions follow their number
        now = now.coalesce(1 + state[0] // ROWS)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
