"""Connected components of a link table by alternating stars; neither links nor labels reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the node's smallest neighbour or itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = both.filter("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, are hung below the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the smallest node that it reaches.

    Each round stores its links in the shared folder; rounds grow with the logarithm of the longest path.
    Nodes without a link do not appear; loops and repeated links change nothing; an empty table gives none.
    """
    now = checkpointed(edges.select("u", "v").filter("u <> v").distinct())
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
        now = checkpointed(_small_star(_large_star(now)))
    leaf = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaf.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
