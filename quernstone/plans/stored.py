"""Indexes of the stand-in relations in the shared folder, one for each session and folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import shared
from ..sources.store import Store
from . import standin

_kept: dict[tuple[str, str], Store] = {}


def build(spark: SparkSession, sf_dir: str) -> Store:
    """A new index of all documents."""
    index = Store(spark, shared.new_path(spark, "index"), lambda docs: (standin.symbols(docs), standin.refs(docs)))
    index.full(standin.docs(spark, sf_dir).withColumn("mtime_ns", F.col("doc_id")))
    _kept[spark.sparkContext.applicationId, sf_dir] = index
    return index


def index(spark: SparkSession, sf_dir: str) -> Store:
    """The index, built by the first query that asks for it."""
    found = _kept.get((spark.sparkContext.applicationId, sf_dir))
    return found or build(spark, sf_dir)


def counts(spark: SparkSession, of: Store) -> DataFrame:
    """One row of what the index says of itself."""
    x = of.status()
    return spark.createDataFrame([(x["doc_count"], x["symbol_count"])], "doc_count long, symbol_count long")
