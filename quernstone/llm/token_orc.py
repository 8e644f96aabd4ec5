"""Token ids of documents in ORC: run-length encoded integers, row indexes, and Bloom filters on the document ids.

A file's stripes are read in parallel; its footer, row-index statistics and Bloom filters let a lookup by doc_id skip
stripes and row groups. No shuffle is needed: each task sorts its own documents by id, so that row-group ranges are
narrow, and encodes them. Defined cases: a null or empty text has no tokens and n_tokens 0; a null doc_id is kept and
never matches a lookup; repeated rows are repeated; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, tokens

VOCABULARY = "byte_bpe_50k.tiktoken"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(64 << 20),
    "orc.rows.between.memory.checks": "500",
}
SCHEMA = "doc_id long, n_tokens int, token_ids array<int>"


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document, in its task and order."""
    data = docs.sparkSession.sparkContext.broadcast(tokens.read_file(folder, vocabulary))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, offs = tokens.load(vocabulary, data.value).encode(b.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs).astype(np.int32)), lists], ["doc_id", "n_tokens", "token_ids"])

    return common.each_batch(common.text_of(docs), batch, SCHEMA)


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, folder: str = tokens.TOKENIZERS) -> None:
    """Writes the documents' token ids to path; see ORC_OPTIONS for the layout."""
    encode(common.text_of(docs).sortWithinPartitions("doc_id"), vocabulary, folder).write.options(**ORC_OPTIONS).orc(path)


def read(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The table at path, or the rows of some documents by pruning on statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written as ORC and read back."""
    path = common.new_path(spark, "tokens")
    write(common.table(spark, sf_dir, "documents"), path)
    return read(spark, path)
