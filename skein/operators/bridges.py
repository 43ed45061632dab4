"""Links whose loss would part their ends.

Links outside a spanning forest close a cycle each. Every such link gets a
64-bit label, which is XORed into both its ends and then up the forest: a
tree link is on no cycle exactly if the labels below it cancel out (but for
a chance of 2 ** -64 a link).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import checkpointed
from .components import components


#: Nodes of a level that a join may send to every task.
FEW = 100_000


def _grown(tree: DataFrame, both: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """tree (node, parent, level) grown from its level 0 until no level adds a node, and the last level."""
    last, n, level = tree, tree.count(), 0
    while n:
        level += 1
        from_ = last.select(F.col("node").alias("src"))
        found = both.join(F.broadcast(from_) if n <= FEW else from_, "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        last = checkpointed(found.join(tree.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        tree = checkpointed(tree.unionByName(last)) if level % 16 == 0 else tree.unionByName(last)
        n = last.count()
    return tree, max(depth, level - 1)


def find_bridges(links: DataFrame) -> DataFrame:
    """links: a and b, in order, as often as may be. Returns a, b of the bridges.

    A forest is grown level by level, from the least a first; only if that
    leaves nodes out are components sought, among these, and grown from the
    least node of each. Rounds are as many as the longest way from there.
    """
    pairs = checkpointed(links.select("a", "b").filter("a <> b").distinct())
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(pairs.select("b", "a"))
    seed = lambda nodes: checkpointed(nodes.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    tree, depth = _grown(seed(pairs.agg(F.min("a").alias("node")).filter("node IS NOT NULL")), both, 0)
    # A link's ends are both in the tree or both left out.
    tree = checkpointed(tree)
    left = checkpointed(pairs.join(tree.select(F.col("node").alias("a")), "a", "left_anti"))
    if not left.isEmpty():
        more, depth = _grown(seed(components(left).filter("node = root").distinct()), left.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(left.select("b", "a")), depth)
        tree = tree.unionByName(more)
    tree = checkpointed(tree)
    in_tree = tree.filter("parent IS NOT NULL").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    rest = pairs.join(in_tree, ["a", "b"], "left_anti").withColumn("label", F.xxhash64("a", "b"))
    ends = rest.select(F.explode(F.array("a", "b")).alias("node"), "label").groupBy("node").agg(F.bit_xor("label").alias("x"))
    marked = checkpointed(tree.join(ends, "node", "left").withColumn("x", F.coalesce("x", F.lit(0).cast("long"))))
    below = None
    bridges = None
    for k in range(depth, 0, -1):
        here = marked.filter(F.col("level") == k)
        if below is not None:
            here = here.join(below, "node", "left").withColumn("x", F.col("x").bitwiseXOR(F.coalesce("more", F.lit(0).cast("long")))).drop("more")
        here = checkpointed(here)
        cut = here.filter("x = 0").select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
        bridges = cut if bridges is None else bridges.unionAll(cut)
        below = here.groupBy(F.col("parent").alias("node")).agg(F.bit_xor("x").alias("more"))
    return bridges if bridges is not None else pairs.limit(0)
