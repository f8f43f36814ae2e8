"""Connected components, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node that can be reached), for every node that an edge names.

    Randomised contraction: in a round every node draws a rank that hangs on the node and the round alone, and is merged
    into the lowest-ranked of its neighbours and itself; edges are then drawn between what their ends were merged into.
    A node merges with its neighbour unless it ranks lowest among them, so the nodes that still have edges fall by a
    constant factor in the mean whatever the shape of the graph or the order of its names: the number of rounds is
    logarithmic, and all rounds together write a small multiple of the graph. Neighbours are reduced within partitions
    before they move, so a hub is a row per partition; the joins that give edges new ends leave skew to Spark. Each round
    is written to the shared folder. Edges with a null end are left out.
    """
    ends = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    e = edges.select(*ends(F.col(a), F.col(b))).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    e, merges = materialise(e, "edges"), []
    while not merges or e.head(1):
        def rank(x, turn=len(merges)):
            return F.xxhash64(F.col(x), F.lit(turn))

        both = e.select(F.col("a").alias("node"), F.struct(rank("b").alias("r"), F.col("b").alias("v")).alias("m"))
        both = both.unionByName(e.select(F.col("b").alias("node"), F.struct(rank("a").alias("r"), F.col("a").alias("v")).alias("m")))
        lowest = both.groupBy("node").agg(F.min("m").alias("m"))
        lowest = lowest.select("node", F.least("m", F.struct(rank("node").alias("r"), F.col("node").alias("v")))["v"].alias("into"))
        merges.append(materialise(lowest, "merges"))
        first, second = (merges[-1].select(F.col("node").alias(x), F.col("into").alias(f"l{x}")) for x in "ab")
        shrunk = materialise(e.join(first, "a").join(second, "b").where("la <> lb").select(*ends(F.col("la"), F.col("lb"))).distinct(), "edges")
        forget(e)
        e = shrunk
    found = merges.pop().select("node", F.col("into").alias("component"))
    while merges:  # what a node was merged into may itself have been merged later
        later = found.select(F.col("node").alias("into"), "component")
        found = merges.pop().join(later, "into", "left").select("node", F.coalesce("component", "into").alias("component"))
    found = materialise(found, "merged")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
