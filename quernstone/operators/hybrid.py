"""Hybrid retrieval: chunks, BM25, vectors, rank fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .. import shared
from ..functions import text as T, words

#: Chunks whose vectors are made together.
_ROWS = 1024
K1, B, TOP, RRF, MIN_OWN = 1.2, 0.75, 200, 60, 3


def own_intervals(symbols: DataFrame) -> DataFrame:
    """(doc_id, sym_idx, line_start, line_end): runs of the lines of each symbol that no symbol strictly within it covers.

    The symbols of a document meet in one row, in order of their first lines; each is folded over those within it.
    """
    end = F.greatest("line_start", "line_end")
    held = symbols.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("line_start").alias("a"), end.alias("b"), "sym_idx"))).alias("all"))
    rows = held.select("doc_id", "all", F.explode("all").alias("s"))
    inner = F.filter("all", lambda o: (o["a"] >= F.col("s.a")) & (o["b"] <= F.col("s.b")) & (o["b"] - o["a"] < F.col("s.b") - F.col("s.a")))
    start = F.struct(F.col("s.a").alias("at"), F.array().cast("array<struct<line_start:int,line_end:int>>").alias("out"))

    def run(a: Column, b: Column) -> Column:
        return F.array(F.struct(a.cast("int").alias("line_start"), b.cast("int").alias("line_end")))

    def step(acc: Column, o: Column) -> Column:
        return F.struct(F.greatest(acc["at"], o["b"] + 1).alias("at"), F.when(o["a"] > acc["at"], F.concat(acc["out"], run(acc["at"], o["a"] - 1))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(inner, start, step, lambda acc: F.when(acc["at"] <= F.col("s.b"), F.concat(acc["out"], run(acc["at"], F.col("s.b")))).otherwise(acc["out"]))
    return rows.select("doc_id", F.col("s.sym_idx").alias("sym_idx"), F.explode(found).alias("i")).select("doc_id", "sym_idx", "i.line_start", "i.line_end")


def windows(start: Column, end: Column, size: int, overlap: int) -> Column:
    """array<struct<line_start, line_end>> of windows over a range; the last ends with it."""
    step = size - overlap
    n = F.when(end - start + 1 <= size, 1).otherwise(F.ceil((end - start + 1 - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((start + i * step).cast("int").alias("line_start"), F.least(start + i * step + size - 1, end).cast("int").alias("line_end")))


def symbol_chunks(symbols: DataFrame) -> DataFrame:
    """(doc_id, sym_idx, name, kind, line_start, line_end, signature): windows of 50 lines, overlapping by 8, of own lines.

    What a symbol that holds others keeps between them is dropped where it has fewer than three lines. A signature goes
    with the first window of each run.
    """
    whole = symbols.select("doc_id", "sym_idx", "name", "kind", "signature", F.col("line_start").alias("a"), F.greatest("line_start", "line_end").alias("b"))
    own = own_intervals(symbols).join(whole, ["doc_id", "sym_idx"])
    leaf = (F.col("line_start") == F.col("a")) & (F.col("line_end") == F.col("b"))
    own = own.where(leaf | (F.col("line_end") - F.col("line_start") + 1 >= MIN_OWN))
    w = own.select("doc_id", "sym_idx", "name", "kind", "signature", F.posexplode(windows(F.col("line_start"), F.col("line_end"), 50, 8)).alias("n", "w"))
    return w.select("doc_id", "sym_idx", "name", "kind", "w.line_start", "w.line_end", F.when(F.col("n") == 0, F.col("signature")).alias("signature"))


def file_chunks(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks of files without symbols: windows of 80 lines, overlapping by 8, over the first 800."""
    bare = docs.where("lines > 0").join(symbols.select("doc_id").distinct(), "doc_id", "left_anti")
    w = bare.select("doc_id", T.file_stem(F.col("path")).alias("name"), F.explode(windows(F.lit(1), F.least("lines", F.lit(800)), 80, 8)).alias("w"))
    return w.select("doc_id", F.lit(-1).alias("sym_idx"), "name", F.lit("file").alias("kind"), "w.line_start", "w.line_end", F.lit(None).cast("string").alias("signature"))


def chunks(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, sym_idx, path, lang, name, kind, line_start, line_end, text, embedded).

    text is what is counted: the path's words twice, the name three times, the signature, the lines. embedded has each
    once. Windows past the end of a file are left out.
    """
    c = symbol_chunks(symbols).unionByName(file_chunks(docs, symbols)).join(docs.select("doc_id", "path", "lang", "lines", F.col("text").alias("_text")), "doc_id")
    c = c.where(F.col("line_start") <= F.col("lines"))
    ls = F.split("_text", r"\r?\n")
    body = F.array_join(F.slice(ls, F.col("line_start"), F.least("line_end", "lines") - F.col("line_start") + 1), "\n")
    told = F.array_join(T.path_tokens(F.col("path")), " ")
    sig = F.coalesce("signature", F.lit(""))
    key = F.xxhash64("doc_id", "sym_idx", "line_start").alias("chunk_id")
    return c.select(key, "doc_id", "sym_idx", "path", "lang", "name", "kind", "line_start", "line_end", F.concat_ws(" ", told, told, "name", "name", "name", sig, body).alias("text"), F.concat_ws(" ", told, "name", sig, body).alias("embedded"))


def stems(text: Column) -> Column:
    return F.transform(T.semantic_tokens(text), T.stem)


def terms(chunks: DataFrame, text: str = "text") -> DataFrame:
    """(chunk_id, term, tf, dl), the table that an index keeps. chunk_id is a key of chunks: they are counted where they lie, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, "text", words.PIECE):
            row, term, names = words.stems(b.column("text"))
            key, tf = np.unique(row * max(len(names), 1) + term, return_counts=True)
            at, which = key // max(len(names), 1), key % max(len(names), 1)
            dl = np.bincount(row, minlength=b.num_rows)[at]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(pa.array(at)), pa.array(names, pa.string()).take(pa.array(which)), pa.array(tf.astype(np.int64)), pa.array(dl.astype(np.int32))], ["chunk_id", "term", "tf", "dl"])

    return shared.map_arrow(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col(text).alias("text")), run, "chunk_id long, term string, tf long, dl int")


def bm25(tf: DataFrame, query: list[str], top: int = TOP, size: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score) of the best chunks, from a table of terms. df is counted for the query's terms alone; n and mean length over all chunks.

    size: one row (n, avgdl), where it is kept.
    """
    if size is None:
        size = tf.groupBy("chunk_id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    return _bm25(tf.where(F.col("term").isin(query)), size, top)


def bm25_scan(chunks: DataFrame, query: list[str], top: int = TOP) -> DataFrame:
    """As bm25, from the chunks' texts: one pass counts each chunk's length and the query's terms in it; those counts alone are kept."""
    query = list(dict.fromkeys(query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.pieces(batches, "text", words.PIECE):
            row, term, names = words.stems(b.column("text"))
            place = {t: i for i, t in enumerate(names)}
            dl = np.bincount(row, minlength=b.num_rows)
            tf = np.stack([np.bincount(row[term == place.get(t, -1)], minlength=b.num_rows) for t in query], axis=1).astype(np.int64) if query else np.empty((b.num_rows, 0), np.int64)
            offs = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(query))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array(dl.astype(np.int32)), pa.ListArray.from_arrays(offs, pa.array(tf.ravel()))], ["chunk_id", "dl", "tfs"])

    texts = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("text"))
    rows = shared.checkpoint(shared.map_arrow(texts, run, "chunk_id long, dl int, tfs array<bigint>").where("dl > 0"))
    size = rows.agg(F.count("*").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))
    hit = rows.select("chunk_id", "dl", F.posexplode("tfs").alias("at", "tf")).where("tf > 0").select("chunk_id", "dl", F.col("at").alias("term"), "tf")
    return _bm25(hit, size, top)


def _bm25(hit: DataFrame, size: DataFrame, top: int) -> DataFrame:
    df = hit.groupBy("term").agg(F.count("*").alias("df"))
    x = hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return x.groupBy("chunk_id").agg(F.round(F.sum(score), 4).alias("score")).where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(top)


def vector_topk(chunks: DataFrame, query: Column, top: int = TOP) -> DataFrame:
    """(chunk_id, score): exact dot products with one vector."""
    return chunks.select("chunk_id", F.round(T.dot(F.col("embedding"), query), 4).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(top)


def weights(query: str) -> tuple[float, float]:
    return (1.0, 0.35) if T.is_symbol_like(query) else (1.0, 2.5)


def fuse(lexical: DataFrame, dense: DataFrame, w: tuple[float, float]) -> DataFrame:
    """Weighted reciprocal ranks of two short lists."""
    order = Window.orderBy(F.desc("score"), "chunk_id")
    a, b = (df.select("chunk_id", (wt / (RRF + F.row_number().over(order))).alias(n)) for df, wt, n in ((lexical, w[0], "a"), (dense, w[1], "b")))
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 8).alias("score"))


def rerank(fused: DataFrame, chunks: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(path, name, line_start, score): best chunk of each file after boosts for names, paths and files with many hits."""
    q = F.array_distinct(stems(F.lit(query)))
    c = fused.join(chunks, "chunk_id").withColumn("q", q)
    names = F.size(F.array_intersect("q", stems(F.col("name"))))
    p = F.size(F.array_intersect("q", stems(F.array_join(T.path_tokens(F.col("path")), " "))))
    low, whole = T.ascii_lower(F.col("name")), T.ascii_lower(F.lit(query))
    boost = F.when(~F.col("kind").isin(*T.PRIORITY_KINDS), 0.0).when(low == whole, 0.030).when(low.contains(whole) | whole.contains(low), 0.012).otherwise(0.0)
    many = F.count("*").over(Window.partitionBy("path"))
    told = F.when(F.size("q") > 0, 0.012 * p * (0.5 + p / F.size("q"))).otherwise(0.0)
    score = F.col("score") + boost + 0.004 * names + told + 0.004 * F.log(many.cast("double")) - T.noise_penalty(F.col("path"))
    best = c.withColumn("s", F.round(score, 6)).withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("s"), "line_start", "chunk_id")))
    return best.where("rn = 1").orderBy(F.desc("s"), "path").limit(k).select("path", "name", "line_start", F.col("s").alias("score"))


def hash_embedding(texts: DataFrame, dim: int = 256, text: str = "text") -> DataFrame:
    """(chunk_id, embedding): signed, sublinear hashed term counts of length one. Distinct terms of a batch are hashed once."""
    if dim < 16:
        raise ValueError("dim must be 16 at least")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in shared.pieces(batches, "text", words.PIECE):
            for lo in range(0, b.num_rows, _ROWS):
                part = b.slice(lo, _ROWS)
                row, term, names = words.stems(part.column("text"))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[term]
                cell = row * dim + (h % np.uint64(dim)).astype(np.int64)
                v = np.bincount(cell, np.where(h >> np.uint64(63), -1.0, 1.0), part.num_rows * dim).reshape(-1, dim)
                v = np.sign(v) * np.where(v != 0, 1 + np.log(np.maximum(np.abs(v), 1e-12)), 0)
                n = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = np.divide(v, n, out=np.zeros_like(v), where=n > 0).astype(np.float32)
                offs = pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("chunk_id"), pa.ListArray.from_arrays(offs, pa.array(v.ravel()))], ["chunk_id", "embedding"])

    return shared.map_arrow(texts.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col(text).alias("text")), embed, "chunk_id long, embedding array<float>")
