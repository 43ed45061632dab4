"""Profiles, comparisons, co-occurrence, the most generic entries, and figures of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CO_OCCURRENCE_RATE, GENERIC_FALLBACK, MAX_CO_OCCURRENCE_CANDIDATES, MAX_COMPARE_NEIGHBOURS, MIN_CO_OCCURRENCE_ACTORS, UNDEFINED_GALAXY
from ..functions.folding import STANDARD, tag
from ..plans.graph import Graph
from ..plans.state import checkpointed
from .traverse import Walk, neighbours


def _node(graph: Graph, uuid: str) -> DataFrame:
    return graph.spark.range(1).select(F.lit(uuid).alias("node"))


def most_generic(graph: Graph, galaxy: str | None = None, limit: int = 10) -> DataFrame:
    """Entries that the most actors are linked to."""
    rows = graph.node_columns("dangling", "group_count").filter("NOT dangling AND group_count > 0")
    if galaxy:
        rows = rows.filter(F.lower("galaxy") == galaxy.lower())
    shown = tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag")
    return rows.orderBy(F.col("group_count").desc(), "value", "uuid").limit(limit if limit > 0 else 10).select("uuid", shown, "value", "galaxy", "group_count")


def galaxies(graph: Graph) -> DataFrame:
    """The inventory: every galaxy with an entry."""
    return graph.galaxies.filter("nodes > 0").orderBy("type")


def stats(graph: Graph, with_bridges: bool = True) -> DataFrame:
    """One row of counts: nodes, edges, bridges, dangling, revoked, synthetic, galaxies, indexed_keys, source_ref."""
    n = graph.plain_nodes.agg(F.count("*").cast("int").alias("nodes"), *[F.count(F.when(F.col(c), 1)).cast("int").alias(c) for c in ("dangling", "revoked", "synthetic")])
    parts = [
        n,
        graph.links.agg(F.count("*").cast("int").alias("edges")),
        graph.galaxies.agg(F.count("*").cast("int").alias("galaxies")),
        graph.index(STANDARD).agg(F.count_distinct("key").cast("int").alias("indexed_keys")),
    ]
    if with_bridges:
        parts.append(graph.bridges.agg(F.count("*").cast("int").alias("bridges")))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out.withColumn("source_ref", F.lit(graph.source_ref))


def _kinds(rows: DataFrame) -> DataFrame:
    """Adds kind: the first that fits of dangling, generic, specific, unattributed; else none."""
    kind = F.when(F.col("dangling"), "dangling").when(F.col("generic"), "generic").when(F.col("group_count") == 1, "specific").when((F.col("group_count") == 0) & ~F.col("is_actor"), "unattributed")
    return rows.withColumn("kind", F.coalesce(kind, F.lit("")))


KINDS = ("specific", "generic", "unattributed", "dangling")


def profile_entries(graph: Graph, uuid: str, depth: int = 1, limit: int = 500) -> DataFrame:
    """The neighbours that a profile sums up, with their kind and group."""
    rows = neighbours(graph, uuid, Walk(depth=depth if depth > 0 else 1, limit=limit if limit > 0 else 500))
    return _kinds(rows).withColumn("group", F.when(F.col("galaxy") == "", UNDEFINED_GALAXY).otherwise(F.col("galaxy")))


def profile(graph: Graph, uuid: str, depth: int = 1, limit: int = 500) -> DataFrame:
    """galaxy, count and counts by kind of an entry's neighbours: actors' galaxies first, then the largest."""
    rows = profile_entries(graph, uuid, depth, limit)
    counts = [F.count(F.when(F.col("kind") == k, 1)).cast("int").alias(k) for k in KINDS]
    grouped = rows.groupBy(F.col("group").alias("galaxy")).agg(F.count("*").cast("int").alias("count"), *counts, F.max("is_actor").alias("is_actor"))
    return grouped.orderBy(F.col("is_actor").desc(), F.col("count").desc(), "galaxy").drop("is_actor")


def generic_cutoff(graph: Graph, names: list[str] | None = None) -> int:
    """The largest group count that a comparison walks through: the least threshold of the galaxies named (or all), less one."""
    t = graph.thresholds.filter("threshold > 1")
    if names:
        t = t.filter(F.col("galaxy_lc").isin(*[n.lower() for n in names]))
    low = t.agg(F.min("threshold")).first()[0]
    return low - 1 if low is not None else GENERIC_FALLBACK


def compared(graph: Graph, a: str, b: str, depth: int = 1, include_generic: bool = False, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """uuid, value, galaxy, group_count, generic, side (shared, a_only, b_only) of two entries' neighbours; and one row of a_truncated, b_truncated, generic_excluded."""
    base = {"depth": depth if depth > 0 else 1, "limit": MAX_COMPARE_NEIGHBOURS, "galaxies": tuple(names or ())}
    cut = 0 if include_generic else generic_cutoff(graph, names)
    sides, figures = [], []
    for k, uuid in (("a", a), ("b", b)):
        rows = neighbours(graph, uuid, Walk(**base, max_group_count=cut))
        figures.append(rows.agg((F.count("*") >= MAX_COMPARE_NEIGHBOURS).alias(f"{k}_truncated")))
        if not include_generic:
            figures.append(neighbours(graph, uuid, Walk(**base)).agg(F.count(F.when(F.col("generic"), 1)).alias(f"{k}_generic")))
        kept = rows.filter("NOT dangling") if include_generic else rows.filter("NOT dangling AND NOT generic")
        sides.append(kept.select("uuid", "tag", "value", "galaxy", "group_count", "generic", F.lit(True).alias(f"in_{k}")))
    columns = ["uuid", "tag", "value", "galaxy", "group_count", "generic"]
    both = sides[0].join(sides[1], columns, "full")
    side = F.when(F.col("in_a") & F.col("in_b"), "shared").when(F.col("in_a"), "a_only").otherwise("b_only")
    facts = figures[0]
    for f in figures[1:]:
        facts = facts.join(F.broadcast(f))  # one row each
    excluded = F.lit(0) if include_generic else F.col("a_generic") + F.col("b_generic")
    return both.select(*columns, side.alias("side")), facts.select("a_truncated", "b_truncated", excluded.cast("int").alias("generic_excluded"))


def compare(graph: Graph, a: str, b: str, depth: int = 1, include_generic: bool = False, names: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Each side's entries, the most telling first (few actors, but one at least), cut to the limit."""
    rows, _ = compared(graph, a, b, depth, include_generic, names)
    order = Window.partitionBy("side").orderBy(F.col("group_count") == 0, "group_count", "value", "uuid")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (limit if limit > 0 else 100))
    return ranked.select("side", "rank", "uuid", "tag", "value", "galaxy", "group_count", "generic")


def compare_summary(graph: Graph, a: str, b: str, depth: int = 1, include_generic: bool = False, names: list[str] | None = None) -> DataFrame:
    """One row: shared_count, a_only_count, b_only_count, similarity, generic_excluded, truncated, all_generic."""
    rows, facts = compared(graph, a, b, depth, include_generic, names)
    counts = rows.agg(*[F.count(F.when(F.col("side") == s, 1)).cast("int").alias(f"{s}_count") for s in ("shared", "a_only", "b_only")], F.coalesce(F.min(F.when(F.col("side") == "shared", F.col("generic"))), F.lit(False)).alias("all_generic"))
    union = F.col("shared_count") + F.col("a_only_count") + F.col("b_only_count")
    similarity = F.when(union > 0, F.col("shared_count") / union).otherwise(F.lit(0.0))
    return counts.join(F.broadcast(facts)).select("shared_count", "a_only_count", "b_only_count", similarity.alias("similarity"), "generic_excluded", (F.col("a_truncated") | F.col("b_truncated")).alias("truncated"), "all_generic")


def co_occurrence_candidates(graph: Graph, uuid: str | None = None, galaxy: str | None = None, min_actors: int = MIN_CO_OCCURRENCE_ACTORS) -> DataFrame:
    """uuid, value, group_count, c_ord of the entries that pairs are made of: the first 500 (which is part of the operator) that fit."""
    if uuid:
        near = graph.adj_of(_node(graph, uuid)).groupBy(F.col("dst").alias("uuid")).agg(F.min("adj_pos").alias("at"))
        pool = graph.node_columns("dangling", "is_actor", "group_count").join(near, "uuid")
    else:
        pool = graph.node_columns("dangling", "is_actor", "group_count", "ord")
        exact = pool.filter("NOT dangling").filter(F.col("galaxy") == (galaxy or "").lower())
        # The lower-cased name itself goes before others that only differ in case.
        pool = (exact if not exact.limit(1).isEmpty() else pool.filter(F.lower("galaxy") == (galaxy or "").lower())).withColumn("at", F.col("ord"))
    floor = min_actors if min_actors > 0 else MIN_CO_OCCURRENCE_ACTORS
    fits = pool.filter(~F.col("dangling") & ~F.col("is_actor") & (F.col("group_count") >= floor)).orderBy("at", "uuid").limit(MAX_CO_OCCURRENCE_CANDIDATES)
    return fits.select("uuid", "value", "group_count", F.row_number().over(Window.orderBy("at", "uuid")).alias("c_ord"))


def co_occurrence(graph: Graph, uuid: str | None = None, galaxy: str | None = None, min_rate: float = CO_OCCURRENCE_RATE, min_actors: int = MIN_CO_OCCURRENCE_ACTORS, limit: int = 20) -> DataFrame:
    """Pairs of entries that nearly the same actors are linked to: those shared over the larger of their numbers."""
    chosen = checkpointed(co_occurrence_candidates(graph, uuid, galaxy, min_actors))
    actors = graph.plain_nodes.filter("is_actor").select(F.col("uuid").alias("actor"))
    near = graph.adj_of(chosen.select(F.col("uuid").alias("node"))).select(F.col("src").alias("uuid"), F.col("dst").alias("actor")).distinct()
    held = near.join(F.broadcast(chosen), "uuid").join(actors, "actor")  # 500 candidates at most
    a = held.select("actor", *[F.col(c).alias(f"a_{c}") for c in ("uuid", "value", "group_count", "c_ord")])
    b = held.select("actor", *[F.col(c).alias(f"b_{c}") for c in ("uuid", "value", "group_count", "c_ord")])
    ends = [f"{s}_{c}" for s in "ab" for c in ("uuid", "value", "group_count", "c_ord")]
    pairs = a.join(b, "actor").filter("a_c_ord < b_c_ord").groupBy(*ends).agg(F.count("*").cast("int").alias("shared"))
    rate = F.col("shared") / F.greatest("a_group_count", "b_group_count")
    rows = pairs.withColumn("rate", rate).filter(F.col("rate") >= min_rate)
    rows = rows.orderBy(F.col("rate").desc(), F.col("shared").desc(), "a_value", "a_c_ord", "b_c_ord").limit(limit if limit > 0 else 20)
    return rows.select("a_uuid", "a_value", F.col("a_group_count").alias("a_group"), "b_uuid", "b_value", F.col("b_group_count").alias("b_group"), "rate", "shared", (F.col("a_group_count") - F.col("shared")).alias("a_only"), (F.col("b_group_count") - F.col("shared")).alias("b_only"))


def node_detail(graph: Graph, uuid: str) -> DataFrame:
    """One row: an entry's fields, degree, group_count and counts of adjacent relations by first type."""
    node = graph.nodes.filter(F.col("uuid") == uuid)
    counts = graph.adj_of(_node(graph, uuid)).groupBy(F.col("src").alias("uuid"), "first_type").agg(F.count("*").cast("int").alias("n"))
    by = counts.groupBy("uuid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("first_type", "n")))).alias("relations_by_type"))
    shown = tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag")
    return node.join(by, "uuid", "left").select("uuid", shown, "value", "galaxy", "description", "synonyms", "revoked", "synthetic", "dangling", "meta", "group_count", "degree", "relations_by_type")


def relations_by_type(graph: Graph, uuid: str) -> DataFrame:
    """first_type, n of the relations at a node, both directions."""
    return graph.adj_of(_node(graph, uuid)).groupBy("first_type").agg(F.count("*").cast("int").alias("n"))
