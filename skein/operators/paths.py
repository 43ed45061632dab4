"""Shortest paths, searched from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_PATH_DEPTH
from ..functions.folding import tag
from ..plans.graph import FEW, Graph
from ..plans.state import checkpointed
from .traverse import mark_bridges, one, passable, start_at, step


def shortest_path(graph: Graph, source: str, target: str, max_depth: int = MAX_PATH_DEPTH, edge_types: tuple[str, ...] = (), with_bridges: bool = False) -> DataFrame:
    """hop, uuid, tag, value, galaxy, via, confidence (and bridge) along a shortest path; no rows if there is none.

    via and confidence tell how a hop was reached. The sides take turns, the
    smaller frontier first, and stop at the first node that both know. Of
    the shortest paths, that whose ends come first in order of arrival, from
    the source and then from the target, up to the node where they meet.
    """
    limit = min(max_depth if max_depth > 0 else MAX_PATH_DEPTH, MAX_PATH_DEPTH)
    edges = lambda nodes, n: passable(graph, nodes, n <= FEW, "both", edge_types)
    sides = [[start_at(one(graph, source))] * 2 + [1], [start_at(one(graph, target))] * 2 + [1]]
    meet = start_at(one(graph, source)) if source == target else None
    depth = 0
    while meet is None and depth < limit and sides[0][2] and sides[1][2]:
        side = sides[0] if sides[0][2] <= sides[1][2] else sides[1]
        other = sides[1] if side is sides[0] else sides[0]
        new = checkpointed(step(side[0], side[1], edges(side[0], side[2]), side[2]))
        side[:] = [new, side[1].unionByName(new), new.count()]
        depth += 1
        known = other[1].select("uuid").distinct()
        if not new.join(known, "uuid", "left_semi").isEmpty():
            meet = True
    spark = graph.spark
    if meet is None:
        hops = spark.createDataFrame([], "hop int, uuid string, via string, confidence int, prev string")
    elif source == target:
        hops = spark.createDataFrame([(0, source, "", 0, None)], "hop int, uuid string, via string, confidence int, prev string")
    else:
        fwd, bwd = (s[1].select("uuid", "depth", "arrival", "path") for s in sides)
        both = fwd.join(bwd.withColumnsRenamed({"depth": "depth2", "arrival": "arrival2", "path": "path2"}), "uuid").filter(F.col("depth") + F.col("depth2") == depth)
        best = both.orderBy("arrival", "arrival2").limit(1)
        route = F.concat("path", F.slice(F.reverse("path2"), 2, 1 << 20))
        placed = checkpointed(best).select(F.posexplode(route).alias("hop", "uuid"), route.alias("route")).withColumn("prev", F.when(F.col("hop") > 0, F.get("route", F.col("hop") - 1)))
        # Of two views of one link either has the same types and confidence.
        ways = edges(placed.select("uuid"), 1).select(F.col("src").alias("prev"), F.col("dst").alias("uuid"), "via", "confidence").groupBy("prev", "uuid").agg(F.min("via").alias("via"), F.min("confidence").alias("confidence"))
        hops = placed.join(ways, ["prev", "uuid"], "left").select("hop", "uuid", F.coalesce("via", F.lit("")).alias("via"), F.coalesce("confidence", F.lit(0)).alias("confidence"), "prev")
    rows = graph.node_columns().join(F.broadcast(hops), "uuid")  # no more than a path's nodes
    out = ["hop", "uuid", tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag"), "value", "galaxy", "via", "confidence"]
    if with_bridges:
        rows = mark_bridges(graph, rows, "prev", "uuid")
        out.append("bridge")
    return rows.select(*out).orderBy("hop")
