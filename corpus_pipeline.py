"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near duplicates stays,
contaminated documents go, and what is left is packed into windows.

Every stage works on all that the stage before it kept. run() writes each stage's result as Parquet in the shared folder
and reads it back, which also cuts the lineage: a lost executor costs the work of one stage. A stage's folder is deleted
when the next one is written. All stages but the last
return the columns of the documents. A document of the line stage keeps its id and gets the length of its new text.
No stage can be told in SQL alone (neighbours by weighted votes, edit distances, sampling, least squares), so the tests
hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, decontaminate, lines, minhash, packing, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: without the documents that the nearest labelled examples call toxic."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: without the lines that an earlier line stands for."""
    return lines.drop_repeated_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: without the documents that hold a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the windows that the documents' tokens go to."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs
