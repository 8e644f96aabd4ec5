"""Repeated passages by a depth-limited radix sort of all suffixes.

Suffixes (one at each word) are ordered only through their first ``depth`` words, most significant digit first; suffixes
that are alone in their digit's bucket leave; groups equal after the last digit are exactly the repeated windows.

* The first digit is a run of ``digit`` words inside the window: the one of least hash among all in the window, the
  leftmost of equals. Equal windows hold it at the same place, so equal windows share the bucket, and all the windows
  for which one run is least travel as one row. That is the only exchange.
* The second digit is the first half of the window's words, the third its second half, as 32-bit hashes: after the
  last digit, windows of a group agree in 128 bits of hashes of their words.

Output: the maximal runs of repeated windows of each document, as positions of words (runs of letters and digits, case
ignored). copies is the greatest number of times a window in the run occurs in the corpus; first tells that the run has
a window that occurs nowhere earlier, by (document row, position), so a run with first = false can go.

Defined cases: null, empty and short texts have no window; a null doc_id is kept as null; each row of a repeated
document counts as a document; overlapping repeats within one document count too; other columns are ignored; a single
text of more than 2^28 words, which no Arrow batch can hold, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, words

DEPTH, DIGIT = 50, 10
_SEEDS = (11, 23, 37)
SCHEMA = "doc_id long, start long, end long, copies long, first boolean"


def least_runs(text: np.ndarray, h: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of each window that lies in one text, position and hash of its least run of digit words)."""
    n, span = len(h) - depth + 1, depth - digit + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    key = words.window_hashes(h, digit, _SEEDS[0])
    at = np.flatnonzero(text[:n] == text[depth - 1 :])
    # least of span neighbours by doubling, (hash, position) ordered: a strict test keeps the leftmost
    best, pos, width = key.copy(), np.arange(len(key)), 1
    while width < span:
        step = min(width, span - width)
        m = len(best) - step
        less = best[step:] < best[:m]
        pos = np.where(less, pos[step:], pos[:m])
        best = np.where(less, best[step:], best[:m])
        width += step
    return at, pos[at], best[at]


def rows_of(col: pa.Array, depth: int, digit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For runs of texts: (row, position of first window, hash of the least run, shift, window hashes, their bounds)."""
    for lo, _, cps, offs in words.layouts(col):
        text, _, _, h = words.words(cps, offs)
        at, pos, key = least_runs(text, h, depth, digit)
        if not len(at):
            continue
        half = depth // 2
        a, b = words.window_hashes(h, half, _SEEDS[1]), words.window_hashes(h, depth - half, _SEEDS[2])
        full = (a[at] & np.uint64(0xFFFFFFFF00000000)) | (b[at + half] >> np.uint64(32))
        new = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)]))
        base = np.searchsorted(text, np.arange(len(offs)))
        t = text[at[new]]
        yield lo + t, at[new] - base[t], key[new], pos[new] - at[new], full, np.append(new, len(at))


def _emit(docs: DataFrame, depth: int, digit: int) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        rows = b.column("row")
        for row, start, key, _, full, bounds in rows_of(b.column("text"), depth, digit):
            if bounds[-1] >= 1 << 28:
                raise ValueError("a text of more than 2^28 words")
            blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(full)])
            take = pa.array(row)
            parts.append(pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("doc_id").take(take), rows.take(take), pa.array(start.astype(np.int32)), blob], ["key", "doc_id", "row", "at", "windows"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    return common.each_batch(docs, batch, "key long, doc_id long, row long, at int, windows binary")


def _segments(first: np.ndarray) -> np.ndarray:
    return np.cumsum(first) - 1


def _repeats(keys: np.ndarray, rows: np.ndarray, ats: np.ndarray, n: np.ndarray, full: np.ndarray):
    """For the rows of whole buckets, in order of key: (index of the row, first window, windows, copies, first)."""
    src = np.repeat(np.arange(len(keys)), n)
    inner = np.arange(len(full)) - np.repeat(np.cumsum(n) - n, n)
    bucket = _segments(np.concatenate([[True], keys[1:] != keys[:-1]]))[src]
    alive = np.arange(len(full))
    for shift in (32, 0):  # most significant digit first; who is alone leaves
        if not len(alive):
            break
        d = (full[alive] >> np.uint64(shift)).astype(np.uint32).astype(np.uint64)
        order = np.argsort((bucket[alive].astype(np.uint64) << np.uint64(32)) | d, kind="stable")
        alive, d, g = alive[order], d[order], bucket[alive][order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        group = _segments(new)
        size = np.bincount(group)
        bucket = bucket.copy()
        bucket[alive] = group
        alive = alive[size[group] > 1]
    if not len(alive):
        return None
    at = ats[src[alive]].astype(np.int64) + inner[alive]
    order = np.lexsort((at, rows[src[alive]], bucket[alive]))
    alive, at = alive[order], at[order]
    g = bucket[alive]
    new = np.concatenate([[True], g[1:] != g[:-1]])
    copies = np.bincount(_segments(new))[_segments(new)]
    order = np.argsort(alive)
    alive, at, copies, first = alive[order], at[order], copies[order], new[order]
    begin = np.concatenate([[True], (alive[1:] != alive[:-1] + 1) | (src[alive[1:]] != src[alive[:-1]])])
    k = np.flatnonzero(begin)
    return src[alive[k]], at[k], np.diff(np.append(k, len(alive))), np.maximum.reduceat(copies, k), np.logical_or.reduceat(first, k)


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets come whole and in order of key; a few buckets are worked on at a time."""
    for t in common.whole_groups(batches, "key", 1 << 14):
        keys = t["key"].to_numpy()
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        keep = np.flatnonzero(np.bincount(_segments(new))[_segments(new)] > 1)  # the windows of one row all differ: their least runs stand at different places in them
        if not len(keep):
            continue
        t = t.take(pa.array(keep)).combine_chunks()
        blob = t["windows"].combine_chunks()
        blob = blob.chunk(0) if isinstance(blob, pa.ChunkedArray) else blob
        offs = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1] // 8
        full = np.frombuffer(blob.buffers()[2], np.uint64)[offs[0] : offs[-1]]
        found = _repeats(t["key"].to_numpy(), t["row"].to_numpy(), t["at"].to_numpy(), np.diff(offs), full)
        if found is None:
            continue
        i, at, count, copies, first = found
        ids = t["doc_id"].combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), pa.array(t["row"].to_numpy()[i]), pa.array(at), pa.array(at + count), pa.array(copies), pa.array(first)], ["doc_id", "row", "lo", "hi", "copies", "first"])


def repeats(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT) -> DataFrame:
    """The maximal runs of words of each document of which every window of depth words occurs at least twice."""
    if not 0 < digit <= depth:
        raise ValueError("digit must be from 1 to depth")
    rows = _emit(common.text_of(docs).withColumn("row", F.monotonically_increasing_id()), depth, digit)
    rows = rows.repartition("key").sortWithinPartitions("key")
    schema = "doc_id long, row long, lo long, hi long, copies long, first boolean"
    runs = common.map_arrow(rows, _sorted_buckets, schema)
    w = "partition by row, doc_id order by lo, hi"
    joined = runs.withColumn("brk", F.expr(f"case when lo <= lag(hi) over ({w}) then 0 else 1 end")).withColumn("g", F.expr(f"sum(brk) over ({w})"))
    spans = joined.groupBy("row", "doc_id", "g").agg(F.min("lo").alias("start"), (F.max("hi") + depth - 1).alias("end"), F.max("copies").alias("copies"), F.max("first").alias("first"))
    return spans.select("doc_id", "start", "end", "copies", "first")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of at least 50 words that occur more than once in the documents."""
    return repeats(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents),
l AS (SELECT doc_id, list_transform(generate_series(1, len(ws) - 49), lambda k: md5(array_to_string(ws[k:k + 49], ' '))) AS hs FROM w WHERE len(ws) >= 50),
p AS (SELECT doc_id, generate_subscripts(hs, 1) - 1 AS p, unnest(hs) AS h FROM l),
g AS (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM p),
k AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g WHERE n > 1)
SELECT doc_id, CAST(min(p) AS BIGINT) AS "start", CAST(max(p) + 50 AS BIGINT) AS "end", CAST(max(n) AS BIGINT) AS copies, bool_or(r = 1) AS "first" FROM k GROUP BY doc_id, island
"""
