"""Helpers shared by the operators: Arrow passes over texts, the shared folder, and checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: A side of a join is broadcast only when its rows, counted first, need no more than this.
BROADCAST_BYTES = 64 << 20
#: Of a batch of texts on its way to Python; the JVM and the worker each hold a few of them.
BATCH_BYTES = 4 << 20
_LIMIT, _SPARKS = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else (tests, one machine) a folder made here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, where it outlives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
        conf = sc._jsc.sc().conf()
        if not conf.contains("spark.cleaner.referenceTracking.cleanCheckpoints"):
            conf.set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # files go when nothing refers to them
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that new_path named."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, in batches of BATCH_BYTES where the session has Spark's own limit; workers give memory back after a task."""
    spark = df.sparkSession
    if spark.conf.get(_LIMIT, _SPARKS) == _SPARKS:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns what the allocators keep for later to the system, so that idle workers are small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def each_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """One pass over df in Arrow batches. fn gets a batch and returns one or none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return map_arrow(df, run, schema)


def text_of(df: DataFrame) -> DataFrame:
    """(doc_id, text), whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys() -> tuple[Column, Column]:
    """128 bits that stand for (doc_id, text), nulls included."""
    parts = F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), F.coalesce("text", F.lit(""))
    return F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *reversed(parts)).alias("k2")


def keyed(docs: DataFrame) -> DataFrame:
    """(d, k1, k2): each row as a struct, and its keys; no name of the row's columns can clash."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
    cast = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cast.select("d", *keys())


def one_of_equal(rows: DataFrame) -> DataFrame:
    """One row of those with the same (k1, k2)."""
    n = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int) -> Iterator[pa.Table]:
    """Rows that come in order of an integer column, in tables of at least so many rows that divide no group of equals."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n < rows:
            continue
        key = held[-1].column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (len(held) > 1 and held[-2].column(column)[-1].as_py() != key[-1]):
            yield pa.Table.from_batches([*held[:-1], held[-1].slice(0, cut)]).combine_chunks()
            held = [held[-1].slice(cut)]
            n = held[0].num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
