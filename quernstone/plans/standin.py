"""The code relations, stood in for by the driver's tables, for queries that SQL can check. Real extraction is in operators.extract.

docs: a path is made of source, language and id, some under tests/ or vendor/. symbols: a line that begins with a
capitalised word defines that word, down to the line before the next such line. refs: words of five small letters or
more are calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import shared
from ..functions import text as T

#: Bytes of texts that are looked at together; arrays of some 40 times this size are held.
_PIECE = 1 << 20
#: Characters of a line that are its signature.
_SHOWN = 60


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, lang, size, lines, hash, text)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.when(F.col("doc_id") % 10 == 0, "tests/").when(F.col("doc_id") % 10 == 1, "vendor/").otherwise("")
    path = F.concat("source", F.lit("/"), part, "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", path.alias("path"), "lang", F.octet_length("text").cast("long").alias("size"), T.line_count(F.col("text")).alias("lines"), F.md5("text").alias("hash"), "text")


def lines(d: DataFrame) -> DataFrame:
    """(doc_id, path, lang, line, raw)."""
    return d.select("doc_id", "path", "lang", F.posexplode(F.split("text", "\n")).alias("p", "raw")).select("doc_id", "path", "lang", (F.col("p") + 1).alias("line"), "raw")


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each text begins and ends, the bytes of all, where the line breaks are)."""
    col = pc.fill_null(texts, "")
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return offs - offs[0], data, np.flatnonzero(data == 10)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces of data between starts and ends."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    chars = data[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(chars))


def symbols(d: DataFrame) -> DataFrame:
    """(doc_id, sym_idx, name, kind, line_start, line_end, container, signature). One Arrow pass over the bytes of a few texts at a time: lines that begin with a capital and a small letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, "text", _PIECE):
            offs, data, breaks = _bytes(b.column("text"))
            start = np.concatenate([offs[:-1], breaks + 1])
            row = np.concatenate([np.arange(b.num_rows), np.searchsorted(offs, breaks, "right") - 1])
            padded = np.concatenate([data, [0, 0]])
            small = (padded >= 97) & (padded <= 122)
            head = (start + 1 < offs[row + 1]) & (padded[start] >= 65) & (padded[start] <= 90) & small[np.minimum(start + 1, len(data))]
            order = np.argsort(start[head], kind="stable")
            start, row = start[head][order], row[head][order]
            others = np.flatnonzero(~small)
            end = np.minimum(others[np.searchsorted(others, start + 1)], offs[row + 1])
            first, lines = np.searchsorted(breaks, offs[:-1]), np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
            nth = np.searchsorted(breaks, start)
            line = nth - first[row] + 1
            follows = np.append(row[1:] == row[:-1], False)[: len(row)]
            last = np.where(follows, np.append(line[1:], 0)[: len(row)] - 1, lines[row])
            stop = np.minimum(np.append(breaks, len(data))[nth], offs[row + 1])
            signature = pc.utf8_slice_codeunits(_cut(data, start, np.minimum(stop, start + 4 * _SHOWN)), 0, _SHOWN)
            kind = pa.array(["class", "function", "method"]).take(pa.array((end - start) % 3))
            nth_in_text = np.arange(len(row)) - np.searchsorted(row, row)
            cols = [b.column("doc_id").take(pa.array(row)), pa.array(nth_in_text.astype(np.int32)), pc.ascii_lower(_cut(data, start, end)), kind, pa.array(line.astype(np.int32)), pa.array(last.astype(np.int32)), pa.nulls(len(row), pa.string()), signature]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sym_idx", "name", "kind", "line_start", "line_end", "container", "signature"])

    return shared.map_arrow(d.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, sym_idx int, name string, kind string, line_start int, line_end int, container string, signature string")


def refs(d: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(doc_id, name, kind, line, column). With names, only texts that contain one are looked at.

    One Arrow pass over the bytes of a few texts at a time: runs of small letters, and the line that each stands on.
    """
    if names is not None:
        wanted = F.lit(False)
        for n in names:
            wanted = wanted | F.col("text").contains(n)
        d = d.where(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, "text", _PIECE):
            offs, data, breaks = _bytes(b.column("text"))
            letter = (data >= 97) & (data <= 122)
            edge = np.zeros(len(data) + 1, bool)
            edge[offs] = True
            before = np.concatenate([[False], letter[:-1]]) & ~edge[:-1]
            after = np.concatenate([letter[1:], [False]]) & ~edge[1:]
            start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
            start, end = start[end - start >= 5], end[end - start >= 5]
            row = np.searchsorted(offs, start, "right") - 1
            nth = np.searchsorted(breaks, start)
            of_text = nth - np.searchsorted(breaks, offs[row])
            begin = np.where(of_text > 0, breaks[np.maximum(nth - 1, 0)] + 1 if len(breaks) else 0, offs[row])
            call = pa.array(["call"]).take(pa.array(np.zeros(len(start), np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), _cut(data, start, end), call, pa.array((of_text + 1).astype(np.int32)), pa.array((start - begin + 1).astype(np.int32))], ["doc_id", "name", "kind", "line", "column"])

    out = shared.map_arrow(d.select("doc_id", "text"), run, "doc_id long, name string, kind string, line int, column int")
    return out if names is None else out.where(F.col("name").isin(names))


#: The same relations for DuckDB; a query is appended.
SQL = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source || '/' || CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'vendor/' ELSE '' END || lang || '/doc_' || doc_id || '.txt' AS path,
    lang, CAST(strlen(text) AS BIGINT) AS size, md5(text) AS hash, text,
    CASE WHEN text = '' THEN 0 ELSE CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS INT) END AS lines
  FROM documents),
lines AS MATERIALIZED (
  SELECT doc_id, path, lang, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line, unnest(string_split(text, chr(10))) AS raw FROM docs),
heads AS MATERIALIZED (SELECT *, regexp_extract(raw, '^([A-Z][a-z]+)', 1) AS w, count(*) OVER (PARTITION BY doc_id) AS n FROM lines),
symbols AS MATERIALIZED (
  SELECT doc_id, CAST(row_number() OVER o - 1 AS INT) AS sym_idx, lower(w) AS name, CASE length(w) % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'method' END AS kind,
    line AS line_start, CAST(coalesce(lead(line) OVER o - 1, n) AS INT) AS line_end, CAST(NULL AS VARCHAR) AS container, substr(raw, 1, 60) AS signature
  FROM heads WHERE w <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
cut AS (SELECT doc_id, line, string_split_regex(raw, '[a-z]{5,}') AS ps, regexp_extract_all(raw, '[a-z]{5,}') AS ws FROM lines),
refs AS (
  SELECT doc_id, name, 'call' AS kind, line, CAST(1 + list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ws[1:i-1], lambda x: strlen(x))), 0) AS INT) AS "column"
  FROM (SELECT doc_id, line, ps, ws, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM cut))
"""

PATH_SCORE = """(-0.05 * (length(path) - length(replace(path, '/', ''))) - CASE WHEN lower(path) LIKE '%test%' OR lower(path) LIKE '%.spec.%' THEN 1.0 ELSE 0.0 END
 - CASE WHEN lower(path) LIKE '%/vendor/%' OR lower(path) LIKE '%/generated/%' OR lower(path) LIKE '%.min.%' THEN 1.5 ELSE 0.0 END)"""
