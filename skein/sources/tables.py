"""A graph over star-schema tables: regions, nations, suppliers (the actors), customers, parts and, undefined, brands."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..plans.graph import Graph

CONFIG = Config(actor_galaxies=("supplier",), scope=None)


def load(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    region, nation, supplier, customer, part, lineitem = map(read, ("region", "nation", "supplier", "customer", "part", "lineitem"))
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    none = F.array().cast("array<string>")

    def entries(df, kind, rank, key, value, synonyms=none):
        return df.select(node(kind, key).alias("uuid"), value.alias("value"), F.lit(kind).alias("galaxy"), F.lit("").alias("description"), synonyms.alias("synonyms"), F.lit(None).cast("string").alias("meta"), F.lit(False).alias("revoked"), F.lit(False).alias("synthetic"), F.struct(F.lit(rank).alias("kind"), F.col(key).cast("long").alias("key")).alias("ord"))

    def declared(df, rank, ends, src, dst, kind, *order):
        keys = [F.col(c).cast("long") for c in order] + [F.lit(0).cast("long")] * (4 - len(order))
        # Ends of one relation are of two kinds, so no end but a missing one is unsound.
        return df.filter(" AND ".join(f"{c} IS NOT NULL" for c in ends)).select(src.alias("src"), dst.alias("dst"), kind.alias("type"), F.struct(F.lit(rank).alias("kind"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], kind.alias("t")).alias("seq"))

    named = [
        entries(region, "region", 0, "r_regionkey", F.col("r_name")),
        entries(nation, "nation", 1, "n_nationkey", F.col("n_name")),
        entries(supplier, "supplier", 2, "s_suppkey", F.col("s_name")),
        entries(customer, "customer", 3, "c_custkey", F.col("c_name"), F.array("c_mktsegment")),
        entries(part, "part", 4, "p_partkey", F.col("p_name"), F.array("p_brand", "p_type")),
    ]
    flag = F.when(F.col("l_returnflag") == "R", "returned-by").when(F.col("l_returnflag") == "A", "accepted-by").otherwise("supplied-by")
    relations = [
        declared(nation, 0, ("n_nationkey", "n_regionkey"), node("nation", "n_nationkey"), node("region", "n_regionkey"), F.lit("part-of"), "n_nationkey"),
        declared(supplier, 1, ("s_suppkey", "s_nationkey"), node("supplier", "s_suppkey"), node("nation", "s_nationkey"), F.lit("located-in"), "s_suppkey"),
        declared(customer, 2, ("c_custkey", "c_nationkey"), node("customer", "c_custkey"), node("nation", "c_nationkey"), F.lit("located-in"), "c_custkey"),
        declared(lineitem, 3, ("l_partkey", "l_suppkey"), node("part", "l_partkey"), node("supplier", "l_suppkey"), flag, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        declared(part, 4, ("p_partkey", "p_brand"), node("part", "p_partkey"), node("brand", "p_brand"), F.lit("branded"), "p_partkey"),
    ]
    together = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionAll(together(frames[1:]))
    return Graph(together(named), together(relations), config=config, sound=True)
