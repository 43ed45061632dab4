"""References of entries and who published them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import trim
from ..functions.links import domain, is_catalogue
from ..plans.graph import Graph
from ..sources.corpus import member_is_wrong, string_list

#: Members of meta that hold references, in order.
MEMBERS = ("refs", "official-refs", "references")


def references_of(rows: DataFrame, key: str, urls: str) -> DataFrame:
    """key, pos, url, domain, self_referential of the distinct links in an array column; catalogues' own records come last."""
    spread = rows.select(key, F.posexplode(urls).alias("at", "raw")).select(key, "at", trim(F.col("raw")).alias("url")).filter("url <> ''")
    first = spread.groupBy(key, "url").agg(F.min("at").alias("at")).withColumn("domain", domain(F.col("url")))
    return first.withColumn("self_referential", is_catalogue(F.col("domain"))).select(key, "at", "url", "domain", "self_referential")


def references(graph: Graph, uuid: str | None = None) -> DataFrame:
    """References of one entry, or of all."""
    nodes = graph.plain_nodes.filter(F.col("meta").isNotNull())
    if uuid is not None:
        nodes = nodes.filter(F.col("uuid") == uuid)
    meta = F.col("meta")
    wrong = member_is_wrong(meta, MEMBERS[0]) | member_is_wrong(meta, MEMBERS[1]) | member_is_wrong(meta, MEMBERS[2])
    lists = F.concat(*[F.coalesce(string_list(meta, m), F.array().cast("array<string>")) for m in MEMBERS])
    rows = references_of(nodes.filter(~wrong).select("uuid", lists.alias("urls")), "uuid", "urls")
    return rows.orderBy("uuid", "self_referential", "at")


def by_publisher(refs: DataFrame) -> DataFrame:
    """domain, count: the most frequent publishers first, catalogues left out."""
    kept = refs.filter("NOT self_referential AND domain <> ''")
    return kept.groupBy("domain").agg(F.count("*").cast("int").alias("count")).orderBy(F.col("count").desc(), "domain")
