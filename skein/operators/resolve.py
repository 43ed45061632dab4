"""Ranked resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folding import STANDARD, cleaned, fold_by, parse_mode, tag
from ..plans.graph import Graph

# Base scores, what a synonym costs in prefix and substring matches, and what a revoked entry costs.
EXACT_VALUE, EXACT_SYNONYM, PREFIX, SUBSTRING, SYNONYM_COST, REVOKED_COST = 100, 90, 70, 40, 5, 200


def scored(pairs: DataFrame) -> DataFrame:
    """Adds reason and score to rows with q_key, key, name_pos and revoked in which key holds q_key."""
    own, same, starts = F.col("name_pos") == 0, F.col("key") == F.col("q_key"), F.col("key").startswith(F.col("q_key"))
    reason = F.when(same, F.when(own, "value").otherwise("synonym")).when(starts, F.when(own, "value_prefix").otherwise("synonym_prefix")).otherwise("substring")
    gap = F.octet_length("key") - F.octet_length("q_key")
    bonus = F.when(gap < 20, F.floor((20 - gap) / 4)).otherwise(0)
    base = F.when(starts, F.lit(PREFIX)).otherwise(F.lit(SUBSTRING)) - F.when(own, 0).otherwise(SYNONYM_COST) + bonus
    score = F.when(same, F.when(own, EXACT_VALUE).otherwise(EXACT_SYNONYM)).otherwise(base) - F.when(F.col("revoked"), REVOKED_COST).otherwise(0)
    return pairs.withColumns({"reason": reason, "score": score.cast("int")})


def _candidates(graph: Graph, hits: DataFrame, galaxies: list[str] | None, limit: int, by: list[str]) -> DataFrame:
    """The best match of each node, ranked and cut within each query."""
    kept = cleaned(galaxies)
    nodes = graph.nodes.filter("NOT dangling")
    if kept:
        nodes = nodes.filter(F.lower("galaxy").isin(*kept))
    rows = scored(hits.join(nodes.select("uuid", "value", "galaxy", "degree", "group_count", "revoked", "synthetic", "synonyms"), "uuid"))
    best = F.row_number().over(Window.partitionBy(*by, "uuid").orderBy(F.col("score").desc(), "name_pos", "key"))
    rows = rows.withColumn("best", best).filter("best = 1")
    order = [F.col("score").desc(), F.col("degree").desc(), "value", "uuid"]
    limit = limit if limit > 0 else 20
    if by:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)
    else:
        rows = rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # limit rows at most
    shown = tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag")
    return rows.select(*by, "rank", "uuid", shown, "value", "galaxy", "reason", "matched", "score", "degree", "group_count", "revoked", "synthetic", "synonyms")


def folded(text: str, mode: str, graph: Graph) -> str:
    """The key of one name."""
    return graph.spark.range(1).select(fold_by(mode, F.lit(text)).alias("k")).first()["k"]


def resolve(graph: Graph, query: str, galaxies: list[str] | None = None, limit: int = 20, mode: str | None = STANDARD) -> DataFrame:
    """Entries whose name or synonym is, starts with or contains the query, best first."""
    mode = parse_mode(mode)
    key = folded(query, mode, graph)
    index = graph.index(mode)
    hits = index.filter(F.col("key").contains(F.lit(key)) & F.lit(key != "")).withColumn("q_key", F.lit(key))
    return _candidates(graph, hits, galaxies, limit, [])


def _grams(key: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(key) - size + 1), lambda i: F.substr(key, i, size))


def resolve_batch(graph: Graph, queries: DataFrame, galaxies: list[str] | None = None, limit: int = 20, mode: str | None = STANDARD) -> DataFrame:
    """resolve() of every row of queries (query_id, query), each cut to its limit.

    A key that contains a query's contains its first three characters (or
    all of it, if shorter), so that the join is on equal grams.
    """
    mode = parse_mode(mode)
    asked = queries.select("query_id", fold_by(mode, F.col("query")).alias("q_key")).filter("q_key <> ''")
    asked = asked.withColumn("size", F.least(F.char_length("q_key"), F.lit(3))).withColumn("gram", F.substr("q_key", F.lit(1), F.col("size")))
    index = graph.index(mode)
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.char_length("key"), F.lit(3))))
    grams = index.withColumn("size", sizes).withColumn("gram", F.explode(F.array_distinct(_grams(F.col("key"), F.col("size")))))
    hits = grams.join(asked, ["size", "gram"]).filter(F.col("key").contains(F.col("q_key"))).drop("size", "gram")
    return _candidates(graph, hits, galaxies, limit, ["query_id"])


def group_by_galaxy(candidates: DataFrame) -> DataFrame:
    """galaxy, count, candidates (in rank order): the largest group first."""
    columns = [c for c in candidates.columns if c != "rank"]
    grouped = candidates.groupBy("galaxy").agg(F.count("*").cast("int").alias("count"), F.sort_array(F.collect_list(F.struct("rank", *columns))).alias("candidates"))
    return grouped.orderBy(F.col("count").desc(), "galaxy")


def has_galaxy(graph: Graph, name: str) -> bool:
    """Whether a galaxy of this name, whatever its case, has an entry."""
    return not graph.plain_nodes.filter("NOT dangling").filter(F.lower("galaxy") == name.lower()).limit(1).isEmpty()
