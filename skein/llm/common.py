"""Helpers that the corpus operators share: table access, checkpoints and Arrow mapping."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Executors get these functions themselves, so this package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word is a run of characters other than space and the ASCII control blanks 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else one set by the caller, else (local runs) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="skein-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


_scopes: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, or below that of the innermost scope."""
    return f"{_scopes[-1] if _scopes else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, name: str):
    """Within it, all intermediate tables go to one folder, which is removed at its end: by then nothing may need them."""
    _scopes.append(shared_path(spark, name))
    try:
        yield
    finally:
        removed(spark, _scopes.pop())


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables through Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Spark's setting by which shuffle files go when the query that made them ends, not when the driver's memory happens to be collected.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str) -> None:
    """Write df as Parquet, rid of its shuffle files afterwards: what is written is read from the files only."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once, written to the shared folder as Parquet and read again: lineage ends here, a lost executor takes nothing with it, and columns can be left unread."""
    path = shared_path(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make() as written() gives it, rid of all intermediate tables that led to it."""
    path = shared_path(spark, name)
    with scope(spark, f"{name}-steps"):
        got = make()
        write(got, path)
    return spark.read.schema(got.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A written step of a longer computation."""
    return written(df, "step")


#: Bytes up to which a lookup table is sent to all executors; beyond that it is shuffled.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, size: Column) -> DataFrame:
    """A written df with a broadcast hint if its rows, of ``size`` bytes each, come to BROADCAST_BYTES at most."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df.hint("shuffle_hash")


def identified(documents: DataFrame) -> DataFrame:
    """documents with __row, which tells rows of one doc_id apart: 0 where no doc_id repeats, else a hash of the text and, of rows alike in both, the number."""
    if documents.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return documents.withColumn("__row", F.lit(0).cast("long"))
    hashed = documents.withColumn("__text_hash", F.xxhash64("text"))
    alike = checkpointed(hashed.groupBy("doc_id", "__text_hash").count().filter("count > 1").select(F.col("doc_id").alias("__alike_doc"), F.col("__text_hash").alias("__alike")))
    same = F.col("doc_id").eqNullSafe(F.col("__alike_doc")) & (F.col("__text_hash") == F.col("__alike"))
    # Whichever of rows alike in doc_id and text gets which number, they hold the same lines.
    several = hashed.join(alike, same, "left_semi").withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "__text_hash").orderBy("__text_hash")))
    every = hashed.join(alike, same, "left_anti").withColumn("__nth", F.lit(1)).unionByName(several)
    return every.withColumn("__row", F.xxhash64("__text_hash", "__nth")).drop("__text_hash", "__nth")


#: Rows, and bytes of their texts, that are Python objects at a time; a row may be larger by itself.
ROWS, ROWS_OUT, BYTES = 256, 4096, 8 << 20


def _sized(kind: pa.DataType) -> bool:
    return pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)


def slices(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and bytes of text (a longer row is a part of its own)."""
    bytes_ = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if _sized(column.type):
            bytes_ += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(bytes_)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        n = max(1, min(rows, fit - at))
        yield batch.slice(at, n)
        at += n


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], Iterator[tuple] | list]], schema: str, chunk: int = ROWS) -> DataFrame:
    """Map rows through Arrow. make() runs once a task and gives a function from a list of row dicts to output tuples.

    What is in memory at a time is bounded by bytes both ways, if the
    function yields its tuples one by one.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    names = kind.names

    def run(batches):
        fn = make()
        arrow = to_arrow_schema(kind)
        texts = [i for i, n in enumerate(names) if _sized(arrow.field(n).type)]

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)], schema=arrow)

        for batch in batches:
            for part in slices(batch, chunk):
                held, size = [], 0
                for row in fn(part.to_pylist()):
                    held.append(row)
                    for i in texts:
                        size += len(row[i] or "")
                    if size >= BYTES or len(held) >= ROWS_OUT:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    return df.mapInArrow(run, schema)


def crc_remainder(column, modulus: int):
    """crc32 of a column's text modulo modulus: how rows are held out from learning. Null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(column, modulus: int, remainder: int) -> Column:
    """Whether a row's remainder is the one held out; false for null ids, which have none (they are never learned from either)."""
    return F.coalesce(crc_remainder(column, modulus) == remainder, F.lit(False))
