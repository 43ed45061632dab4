"""Fuzzy name matching with a score made up of named signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.folding import STANDARD, cleaned, fold, tag
from ..plans.graph import Graph

#: Queries that a join may send to every task, each once for every length in reach.
FEW = 10_000
#: Members of meta in which two entries that are one would agree.
DISCRIMINATORS = ("country",)


def with_signals(pairs: DataFrame, least: float | None = None) -> DataFrame:
    """Adds the signals and similarity to rows with q_key, query, key and matched.

    With ``least``, rows go beforehand that could not reach it even if the
    only signal that takes Python, Jaro-Winkler, were 1.
    """
    ta, tb = sim.tokens(F.col("query")), sim.tokens(F.col("matched"))
    rows = pairs.withColumns({"qt": ta, "mt": tb})
    many = (F.size("qt") > 1) | (F.size("mt") > 1)
    initials = sim.has_initial(F.col("qt")) | sim.has_initial(F.col("mt"))
    qt, mt, zero = F.col("qt"), F.col("mt"), F.lit(0.0)
    rows = rows.withColumns({
        "levenshtein": sim.levenshtein_ratio(F.col("q_key"), F.col("key")),
        "token_overlap": F.when(many, sim.token_overlap(qt, mt)).otherwise(zero),
        "abbreviation": F.when(initials, sim.abbreviation(qt, mt)).otherwise(zero),
        "digit_match": sim.digit_match(F.col("q_key"), F.col("key")),
        "many": many, "initials": initials,
    })
    known = {n: F.col(n) for n in ("levenshtein", "token_overlap", "abbreviation", "digit_match")}
    if least is not None:
        rows = rows.filter(sim.composite({"jaro_winkler": F.lit(1.0)} | known, F.col("many"), F.col("initials")) >= least)
    rows = rows.withColumn("jaro_winkler", sim.jaro_winkler_column("q_key", "key"))
    rows = rows.withColumn("similarity", sim.composite({"jaro_winkler": F.col("jaro_winkler")} | known, F.col("many"), F.col("initials")))
    return rows.drop("qt", "mt", "many", "initials")


def meta_string(meta: Column, name: str) -> Column:
    """A member of a JSON object if it is a string, else null."""
    v = F.try_variant_get(F.try_parse_json(meta), f"$['{name}']", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _matches(graph: Graph, queries: DataFrame, pairs: DataFrame, galaxies: list[str] | None, threshold: float, limit: int) -> DataFrame:
    kept = cleaned(galaxies)
    nodes = graph.plain_nodes.filter("NOT dangling")
    if kept:
        nodes = nodes.filter(F.lower("galaxy").isin(*kept))
    rows = with_signals(pairs, threshold).filter(F.col("similarity") >= threshold).join(nodes.select("uuid", "value", "galaxy", "meta"), "uuid")
    best = F.row_number().over(Window.partitionBy("query_id", "uuid").orderBy(F.col("similarity").desc(), "name_pos", "key"))
    rows = rows.withColumn("best", best).filter("best = 1").drop("best")
    # A query that is the name of exactly one entry, in any galaxy, stands for that entry.
    keys = queries.select("query_id", fold(F.col("query")).alias("q_key")).filter("q_key <> ''").distinct()
    standard = graph.index(STANDARD, keys.select(F.char_length("q_key").alias("length")))
    alone = standard.join(keys, F.col("key") == F.col("q_key")).groupBy("query_id").agg(F.min("uuid").alias("self"), F.count("*").alias("n")).filter("n = 1")
    mine = alone.join(graph.plain_nodes.select(F.col("uuid").alias("self"), F.col("meta").alias("self_meta")), "self").select(F.col("query_id").alias("own_id"), "self", "self_meta")
    rows = rows.join(mine, F.col("query_id") == F.col("own_id"), "left")
    reason = F.lit(None).cast("string")
    for name in reversed(DISCRIMINATORS):
        a, b = meta_string(F.col("self_meta"), name), meta_string(F.col("meta"), name)
        clash = (F.col("self") != F.col("uuid")) & (a != "") & (b != "") & (F.lower(a) != F.lower(b))
        reason = F.when(clash, F.concat(F.lit(f"conflicting {name}: "), a, F.lit(" vs "), b)).otherwise(reason)
    rows = rows.withColumn("blocked_reason", reason).withColumn("blocked", F.col("blocked_reason").isNotNull())
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("blocked", F.col("similarity").desc(), "value", "uuid"))
    rows = rows.withColumn("rank", rank).filter(F.col("rank") <= (limit if limit > 0 else 20))
    shown = tag(graph.config.namespace, F.col("galaxy"), F.col("value")).alias("tag")
    return rows.select("query_id", "rank", "uuid", shown, "value", "galaxy", "matched", "similarity", "jaro_winkler", "levenshtein", "token_overlap", "abbreviation", "digit_match", "blocked", "blocked_reason")


def near_pairs(graph: Graph, queries: DataFrame) -> DataFrame:
    """Index rows to compare with each row of queries (query_id, query): all but the query's own key, of a length within four characters.

    Lengths are joined as equal numbers, one for each length in reach.
    """
    gap = sim.MAX_LENGTH_GAP
    asked = queries.select("query_id", "query", fold(F.col("query")).alias("q_key")).filter("q_key <> ''")
    n = F.char_length("q_key")
    few = asked.limit(FEW + 1).count() <= FEW
    asked = asked.withColumn("length", F.explode(F.sequence(F.greatest(n - gap, F.lit(1)), n + gap)))
    index = graph.index(STANDARD, asked).withColumn("length", F.char_length("key"))
    # Most names may be of one length, so few queries go to every task instead of a length to one.
    return index.join(F.broadcast(asked) if few else asked, "length").filter("key <> q_key").drop("length")


def fuzzy_batch(graph: Graph, queries: DataFrame, galaxies: list[str] | None = None, min_similarity: float = sim.FUZZY_THRESHOLD, limit: int = 20) -> DataFrame:
    """Near names of every row of queries (query_id, query)."""
    pairs = near_pairs(graph, queries)
    return _matches(graph, queries, pairs, galaxies, min_similarity, limit)


def fuzzy(graph: Graph, query: str, galaxies: list[str] | None = None, min_similarity: float = sim.FUZZY_THRESHOLD, limit: int = 20) -> DataFrame:
    """Near names of one query."""
    asked = graph.spark.createDataFrame([(0, query)], "query_id int, query string")
    return fuzzy_batch(graph, asked, galaxies, min_similarity, limit).drop("query_id")
