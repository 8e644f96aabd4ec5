"""Streaming upkeep of the index and event-time reports: a file stream applies changes batch by batch.

The trigger is the debounce: all that arrives within it is one incremental build. Only the manifest's rename makes a
batch visible, and a batch that is replayed finds nothing left to do, so a failed driver repeats none of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..sources import store, tree


def relevant(rel: Column) -> Column:
    """Whether a change at a relative path matters: not in the index's folder, not hidden."""
    return ~rel.startswith(tree.INDEX_DIR + "/") & ~rel.rlike(r"(^|/)\.")


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path by (seq)."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"))
    return events.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def apply(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch of (path, seq, op, ...) events: op is put or delete."""
    last = latest(batch)
    kept = state.join(last.select("path"), "path", "left_anti")
    return kept.unionByName(last.where("op = 'put'").select(*state.columns))


def follow(stream: DataFrame, index: store.Store, documents: Callable[[DataFrame], DataFrame], checkpoint: str, debounce_ms: int = 300, once: bool = False) -> StreamingQuery:
    """Runs one incremental build a trigger. documents: a batch of events -> all documents there are now."""

    def build(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index.incremental(documents(batch))

    writer = stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()


def windowed_savings(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event-time sums of a stream of savings; rows later than the watermark are left out."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("queries"), F.sum("value").alias("value"))


def file_stream(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
