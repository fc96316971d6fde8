"""Connected components of an edge table, by alternating large and small stars.

Every round relinks neighbours to the least node that they know; tables halve in depth, so rounds grow
with the logarithm of the longest path. All state stays in tables in the shared scratch folder; what
comes to the driver is a count and a checksum a round. A hub's least neighbour is aggregated before the
shuffle and stored, so that both sides of the join that follows come from exchanges of its own, whose
skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.llm.common import Scratch


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = scratch.store(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    down = scratch.store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "down")
    least = scratch.store(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, outer: Scratch, name: str) -> DataFrame:
    """node, root: each node of ``edges`` (a, b; any ordered type, no nulls) with the least node of its
    component; a table of ``outer``. Loops and repeated edges do no harm; no edges: no rows."""
    before, scratch = None, Scratch(edges.sparkSession)
    edges = scratch.store(edges.where("a <> b").select("a", "b").distinct(), name)
    while True:
        following = Scratch(edges.sparkSession)
        edges = following.store(_small(_large(edges, scratch), scratch), name)
        scratch.clear()
        scratch = following
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = outer.store(leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), name)
    scratch.clear()
    return found
