"""Bounded walks: what is near an entry, breadth first.

A walk's order of arrival is that of the lists of edge positions along its
paths, so it needs no numbering across all rows: of the ways to reach a node
at its least depth, the one with the least list came first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GENERIC_FALLBACK, MAX_DEPTH, MAX_VISITED
from ..functions.folding import cleaned, tag
from ..plans.graph import FEW, Graph
from ..plans.state import checkpointed


@dataclass(frozen=True)
class Walk:
    """How to walk. Edge types and max_group_count stop a walk; galaxies and skip_dangling only hide what it passes."""

    depth: int = 1
    direction: str = "both"
    edge_types: tuple[str, ...] = ()
    galaxies: tuple[str, ...] = ()
    max_group_count: int = 0
    skip_dangling: bool = False
    max_visited: int = MAX_VISITED
    limit: int = 200


def via(types: list[str]) -> Column:
    """The type by which an edge passes a filter of relation types: its first one, else the first in order; null if none does."""
    if not types:
        return F.col("first_type")
    passes = lambda t: F.lower(t).isin(*types)
    return F.when(passes(F.col("first_type")), F.col("first_type")).otherwise(F.get(F.filter("types", passes), F.lit(0)))


def passable(graph: Graph, nodes: DataFrame, few: bool = True, direction: str = "both", edge_types=(), max_group_count: int = 0) -> DataFrame:
    """Edges from the nodes (uuid) that a walk may take, with via; few: the nodes are sent to every task."""
    adj = graph.adj_of(nodes.select(F.col("uuid").alias("node")), few)
    if direction in ("out", "in"):
        adj = adj.filter(F.col("dir") == direction)
    if max_group_count > 0:
        adj = graph.counted(adj, "group_count", on="dst").filter(F.col("group_count") <= max_group_count).drop("group_count")
    return adj.withColumn("via", via(cleaned(list(edge_types)))).filter("via IS NOT NULL")


def few_of(rows: DataFrame, n: int) -> DataFrame:
    """n rows, sent to every task if they are few."""
    return F.broadcast(rows) if n <= FEW else rows


def start_at(starts: DataFrame) -> DataFrame:
    """Depth 0 of walks from starts (start: a node's uuid)."""
    empty = F.array().cast("array<bigint>")
    return starts.select("start", F.col("start").alias("uuid"), F.lit(0).alias("depth"), empty.alias("arrival"), F.array("start").alias("path"), F.lit("").alias("via"), F.lit(0).alias("confidence"), F.lit(None).cast("string").alias("from_uuid"))


def step(frontier: DataFrame, visited: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """Nodes first reached from the frontier (n rows), one row for each start and node."""
    f = frontier.select("start", F.col("uuid").alias("src"), "depth", "arrival", "path")
    reached = edges.join(few_of(f, n), "src").join(visited.select("start", F.col("uuid").alias("dst")), ["start", "dst"], "left_anti")
    way = F.struct(F.concat("arrival", F.array("adj_pos")).alias("arrival"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("dst")).alias("path"), "via", "confidence", F.col("src").alias("from_uuid"))
    first = reached.groupBy("start", F.col("dst").alias("uuid")).agg(F.min(way).alias("w"))
    return first.select("start", "uuid", "w.depth", "w.arrival", "w.path", "w.via", "w.confidence", "w.from_uuid")


def _within_cap(frontier: DataFrame, found: DataFrame, before: DataFrame, cap: int) -> DataFrame:
    """Of the nodes found, those whose parents a sequential walk still expands.

    It stops once it has visited ``cap`` nodes, which it looks at between
    parents only. A start's frontier is below the cap plus one node's
    degree, as this is asked for at every level.
    """
    per_parent = found.groupBy("start", F.col("from_uuid").alias("uuid")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("start").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    parents = frontier.join(per_parent, ["start", "uuid"], "left").join(before, "start")
    seen = F.col("visited") + F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(order), F.lit(0))
    open_ = parents.withColumn("seen", seen).filter(F.col("seen") < cap).select("start", F.col("uuid").alias("from_uuid"))
    return found.join(open_, ["start", "from_uuid"], "left_semi").select(*found.columns)


def walk(graph: Graph, starts: DataFrame, how: Walk) -> DataFrame:
    """start, uuid, depth, arrival, path, via, confidence, from_uuid of all that walks from starts (start) reach, ends left out."""
    return _walked(graph, starts, how)[0]


def _walked(graph: Graph, starts: DataFrame, how: Walk) -> tuple[DataFrame, int]:
    """walk(), and how many rows it has.

    A start that has visited as many nodes as it may is walked no further,
    as none of its parents would be expanded; so what is still walked from
    is less than that for each start.
    """
    depth = min(how.depth if how.depth > 0 else 1, MAX_DEPTH)
    cap = how.max_visited if how.max_visited > 0 else MAX_VISITED
    frontier = visited = start_at(starts)
    n, total = starts.count(), 0
    counts = frontier.groupBy("start").agg(F.count("*").alias("visited")) if depth > 1 else None
    most, least = 1, 1
    for level in range(depth):
        if cap <= least:
            break
        if most >= cap:
            frontier = frontier.join(counts.filter(F.col("visited") < cap), "start", "left_semi")
        edges = passable(graph, frontier, n <= FEW, how.direction, how.edge_types, how.max_group_count)
        found = checkpointed(step(frontier, visited, edges, n))
        if level + 1 < depth or level:
            reached = found.groupBy("start").agg(F.count("*").alias("more"))
            after = F.col("visited") + F.coalesce("more", F.lit(0))
            if (counts.join(reached, "start", "left").agg(F.max(after)).first()[0] or 0) >= cap:
                found = checkpointed(_within_cap(frontier, found, counts, cap))
                reached = found.groupBy("start").agg(F.count("*").alias("more"))
            counts = checkpointed(counts.join(reached, "start", "left").select("start", after.alias("visited")))
            least, most = counts.agg(F.min("visited"), F.max("visited")).first()
            if least is None:
                break
        n = found.count()
        total += n
        frontier, visited = found, visited.unionByName(found)
        if not n:
            break
    return visited.filter("depth > 0"), total


def generic_columns(graph: Graph, rows: DataFrame) -> DataFrame:
    """Adds generic_threshold and generic to rows with galaxy and group_count."""
    t = graph.thresholds.withColumnRenamed("galaxy_lc", "t_galaxy")
    rows = rows.join(F.broadcast(t), F.lower("galaxy") == F.col("t_galaxy"), "left").drop("t_galaxy")  # a row for each galaxy of ten entries or more
    threshold = F.coalesce("threshold", F.lit(GENERIC_FALLBACK))
    return rows.withColumns({"generic_threshold": threshold, "generic": F.col("group_count") > threshold}).drop("threshold")


def _class(rows: DataFrame) -> Column:
    """Actors first, then what actors are linked to, then what none is, then the undefined."""
    return F.when(F.col("is_actor"), 0).when(F.col("dangling"), 3).when(F.col("group_count") > 0, 1).otherwise(2)


def neighbours_batch(graph: Graph, starts: DataFrame, how: Walk = Walk()) -> DataFrame:
    """Ranked neighbours of every start, each cut to the limit after ranking."""
    reached, n = _walked(graph, starts, how)
    rows = graph.described(reached, n <= FEW)
    if how.skip_dangling:
        rows = rows.filter("NOT dangling")
    if kept := cleaned(list(how.galaxies)):
        rows = rows.filter(F.lower("galaxy").isin(*kept))
    rows = generic_columns(graph, graph.counted(rows, "group_count"))
    rows = rows.withColumn("class", _class(rows))
    order = Window.partitionBy("start").orderBy("depth", "class", "group_count", "value", "arrival")
    rows = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (how.limit if how.limit > 0 else 200))
    shown = tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag")
    return rows.select("start", "rank", "uuid", shown, "value", "galaxy", "depth", "via", "confidence", "group_count", "generic", "generic_threshold", "from_uuid", "dangling", "is_actor", "path")


def one(graph: Graph, uuid: str) -> DataFrame:
    return graph.spark.createDataFrame([(uuid,)], "start string")


def neighbours(graph: Graph, uuid: str, how: Walk = Walk(), with_bridges: bool = False) -> DataFrame:
    """Ranked neighbours of one node."""
    rows = neighbours_batch(graph, one(graph, uuid), how)
    return mark_bridges(graph, rows, "from_uuid", "uuid") if with_bridges else rows


def mark_bridges(graph: Graph, rows: DataFrame, src: str, dst: str) -> DataFrame:
    """Adds bridge: whether the link between two columns' nodes is the only join of its sides."""
    b = graph.bridges.withColumn("bridge", F.lit(True))
    return rows.withColumns({"a": F.least(src, dst), "b": F.greatest(src, dst)}).join(b, ["a", "b"], "left").drop("a", "b").withColumn("bridge", F.coalesce("bridge", F.lit(False)))


def neighbours_by_relation(graph: Graph, uuid: str, limit: int = 1000) -> DataFrame:
    """via, galaxy, count of the nearest neighbours."""
    rows = neighbours(graph, uuid, Walk(limit=limit))
    return rows.groupBy("via", "galaxy").agg(F.count("*").cast("int").alias("count"))
