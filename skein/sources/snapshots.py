"""Graphs kept as versioned Parquet snapshots, and the one that is current."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..plans.graph import TABLES, Graph, StoredGraph


def publish(graph: Graph, folder: str) -> str:
    """Write all tables of a graph as a new version below folder, then make it current. Readers of older versions go on with theirs.

    adj is laid out by src and name_index by mode, so that a walk or a look
    at one mode reads little.
    """
    spark, version = graph.spark, uuid.uuid4().hex
    path = f"{folder}/{version}"
    for name in TABLES:
        df = getattr(graph, name)
        writer = df.sort("src", "adj_pos").write if name == "adj" else df.write.partitionBy("mode") if name == "name_index" else df.write
        writer.parquet(f"{path}/{name}")
    marks = spark.createDataFrame([(version, graph.source_ref)], "version string, source_ref string")
    marks.coalesce(1).withColumn("published_at", F.current_timestamp()).write.mode("append").json(f"{folder}/versions")
    return version


def current_version(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The latest version and its source_ref."""
    got = spark.read.schema("version string, source_ref string, published_at timestamp").json(f"{folder}/versions").orderBy(F.col("published_at").desc(), "version").first()
    if got is None:
        raise FileNotFoundError(f"nothing is published in {folder}")
    return got["version"], got["source_ref"] or ""


def open_graph(spark: SparkSession, folder: str, config: Config = Config(), version: str | None = None) -> StoredGraph:
    """A published graph: the current version unless one is named."""
    found, ref = (version, "") if version else current_version(spark, folder)
    return StoredGraph({t: spark.read.parquet(f"{folder}/{found}/{t}") for t in TABLES}, config, ref)
