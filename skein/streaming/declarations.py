"""Keep a table of merged links up to date from a stream of declarations.

Each batch is summed up by pair first; its sums are appended as increments,
from which the links are merged on reading. A batch that is run again after
a failure overwrites its own increment, so every declaration counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _summed(d: DataFrame) -> DataFrame:
    kept = d.filter((F.coalesce("dst", F.lit("")) != "") & (F.col("dst") != F.col("src"))).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("type", F.lit("")).alias("type"), "seq")
    return kept.groupBy("a", "b").agg(F.min(F.struct("seq", "type")).alias("first"), F.collect_set(F.when(F.col("type") != "", F.col("type"))).alias("types"), F.count("*").alias("n"))


def follow(declarations: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that adds streamed declarations (src, dst, type, seq) to the increments in folder."""

    def add(batch: DataFrame, number: int) -> None:
        _summed(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return declarations.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_links(spark: SparkSession, folder: str) -> DataFrame:
    """a, b, first_type, types, confidence over all increments."""
    parts = spark.read.parquet(folder)
    merged = parts.groupBy("a", "b").agg(F.min("first")["type"].alias("first_type"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"), F.sum("n").cast("int").alias("confidence"))
    return merged
