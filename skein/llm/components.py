"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Up to so many edges, a node's neighbours are read in one task; beyond that they are joined, so that a node of many is dealt out.
FEW = 1 << 18


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """One step. large: tie each node's larger neighbours to its least neighbour; else its smaller ones and itself."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if few:
        found = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
        if large:
            return found.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ties = found.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("tie"))
        return ties.select("tie.*").filter("u <> v").distinct()
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("w", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("w"))
    if large:  # an edge each, so repeated ones can wait for the other step
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v of one orderable type. Returns node, root: the least node of each one's component, for every node with an edge to another.

    Loops, nulls and repeated edges don't matter. Every round is kept in the
    shared checkpoint folder; nothing but a count and a checksum of the
    edges reaches the driver.
    """
    marked = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = marked(now)
    for _ in range(rounds):
        few = mark[0] <= FEW
        now, old = checkpointed(_star(_star(now, True, few), False, few)), mark
        mark = marked(now)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components are still changing after {rounds} rounds")
    # Every node now hangs on its component's least node.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
