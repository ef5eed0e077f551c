"""Connected components of an edge table, by large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkweave.llm.frames import checkpointed


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node that has an edge to another; component is its smallest node.

    Loops and repeated edges are harmless, rows with a null end are left out. Each round is two aggregations and
    a join on node numbers, with minima taken before the shuffle; the driver only hears whether all are stars. Rounds grow with the logarithm of the longest chain.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = checkpointed(e)
    while not _stars(e):
        e = checkpointed(_small_star(_large_star(e)))
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, which has none itself. Both sides of the join are aggregated, so no key is hot."""
    above, below = e.groupBy("u").agg(F.count("*").alias("n")), e.select(F.col("v").alias("hub")).distinct()
    return above.join(below, F.col("u") == F.col("hub"), "left").where("n > 1 or hub is not null").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Each node tells its larger neighbours of its smallest neighbour."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # A table of its own, so that the join is of two plain shuffles and adaptive execution can split a hub's edges.
    smallest = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    larger = e.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return larger.join(smallest, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    smallest = checkpointed(e.groupBy("u").agg(F.min("v").alias("m")))  # as above
    linked = e.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return linked.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
