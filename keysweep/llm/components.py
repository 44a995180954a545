"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysweep.session import checkpoint_root

#: Edges of one part of a checkpoint, and its fewest parts: a few edges in hundreds of parts take longer to start than to read.
PART_EDGES, LEAST_PARTS = 20_000, 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the smallest node of its component) for every node of an edge.

    Each step hangs a node's neighbours on the smallest of them and ends when nothing moves, after a number of steps that
    grows with the logarithm of the longest chain. Edges stay in the cluster and every step is checkpointed; a node with very
    many neighbours is only ever aggregated or joined, never collected. No edges: no rows. Loops and repeated edges change
    nothing. ``edges`` should be a table, as it is counted first.
    """
    checkpoint_root(edges.sparkSession)
    now = _distinct(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    before, most = None, edges.count()
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        now = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # v > u >= m
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        now = _distinct(now.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v"))
        now = now.coalesce(max(LEAST_PARTS, (before[0] if before else most) // PART_EDGES)).checkpoint()
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select("v", "v").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger node to the smaller; no loops."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
