"""Packing of documents into windows by non-negative least squares over the histogram of their lengths.

Lengths are token counts of a public vocabulary. A document longer than a window gives full windows and a rest. The
rests are counted in a histogram of ``window / grain`` bins, lengths rounded up. All combinations of at most ``depth``
bins that fill a window exactly are enumerated; the repeat count of each is solved for by non-negative least squares
against the histogram, rounded, and cut to what the histogram holds. Pieces are then numbered within their bins, and a
number says which repeat of which combination the piece goes to. What is left over is packed greedily, best fit
decreasing, as one: the driver packs the counts of the exact lengths, whole runs of equal windows at a time, and pieces
find their window by their number within their length.

At scale: the histogram and both plans are as large as the window, whatever the corpus; numbering is a prefix sum over
(bin, part) or (length, part), with parts by hash so that no task holds a whole bin; only (key, length) rows are shuffled.

Defined cases: a null or empty text has no tokens and is in no window; a null doc_id is kept; repeated rows are each
packed; ties in length are broken by doc_id, then by position in the input; other columns are ignored; an empty table
gives no windows. Every token of every document is in exactly one window, and no window holds more than ``window``.
"""

from __future__ import annotations

import bisect
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from . import common, tokens

WINDOW, GRAIN, DEPTH, PART = 2048, 16, 3, 100_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "window_id string, slot int, offset int, doc_id long, start long, length int"


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    data = docs.sparkSession.sparkContext.broadcast(tokens.read_file(folder, vocabulary))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        _, offs = tokens.load(vocabulary, data.value).encode(b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offs))], ["doc_id", "n_tokens"])

    return common.each_batch(common.text_of(docs), batch, "doc_id long, n_tokens long")


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most depth bin numbers from 1 to bins whose sum is bins."""
    out: list[tuple[int, ...]] = [(bins,)]
    for d in range(2, depth + 1):
        out += [c + (bins - sum(c),) for c in combinations_with_replacement(range(1, bins // 2 + 1), d - 1) if bins - sum(c) >= c[-1]]
    return out


def nnls(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The x >= 0 of least |a x - h|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(h).max(initial=0))) * a.shape[0]
    for _ in range(3 * n):
        w = a.T @ (h - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if passive.all() or w[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            try:
                s = np.linalg.solve(a[:, p].T @ a[:, p], a[:, p].T @ h)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(a[:, p], h, rcond=None)[0]
            if len(p) == 0 or s.min() > 1e-12:
                x[:] = 0
                x[p] = s
                break
            bad = s <= 1e-12
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - s[bad], 1e-300))
            x[p] += step * (s - x[p])
            drop = p[(x[p] <= 1e-12) & bad]
            passive[drop if len(drop) else p[bad][:1]] = False
            x[~passive] = 0
    return x


def solve(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that the histogram, of bins 1 and up, can supply, in a fixed order."""
    bins = len(histogram)
    combos = combinations(bins, depth)
    a = np.zeros((bins, len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], np.array(c) - 1, 1.0)
    x = nnls(a, histogram.astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for j in sorted(np.flatnonzero(x > 0).tolist(), key=lambda j: (-x[j], j)):
        use = a[:, j].astype(np.int64)
        n = min(round(float(x[j])), int((left[use > 0] // use[use > 0]).min()))
        if n > 0:
            left -= n * use
            out.append((combos[j], n))
    return out


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best fit decreasing of counts[length] pieces: (length, lo, hi, each, window, slot, offset) of runs of pieces.

    Pieces lo to hi - 1 of a length go to windows from the given one on, so many to each, from a slot and offset on.
    A piece goes to the open window with the least room that it fits, so a window takes as many of a length as it holds.
    Windows that hold the same stay one run of numbers: the work is by runs, not by pieces.
    """
    room: dict[int, list[tuple[int, int, int]]] = {}  # room: runs (first window, windows, slots used)
    open_: list[int] = []
    plan, windows = [], 0

    def put(free: int, run: tuple[int, int, int]) -> None:
        if run[1] and free:
            if free not in room:
                room[free] = []
                bisect.insort(open_, free)
            room[free].append(run)

    for length in sorted(counts, reverse=True):
        done, n = 0, counts[length]
        while done < n:
            k = bisect.bisect_left(open_, length)
            if k < len(open_):
                free = open_[k]
                first, many, slot = room[free].pop()
                if not room[free]:
                    del room[open_.pop(k)]
            else:
                free, slot, first, many = window, 0, windows, -(-(n - done) // (window // length))
                windows += many
            each = free // length
            full = min(many, (n - done) // each)
            if full:
                plan.append((length, done, done + full * each, each, first, slot, window - free))
                put(free - each * length, (first, full, slot + each))
                done += full * each
            rest = n - done
            if rest and full < many:  # the last pieces of the length
                plan.append((length, done, n, rest, first + full, slot, window - free))
                put(free - rest * length, (first + full, 1, slot + rest))
                done, full = n, full + 1
            put(free, (first + full, many - full, slot))
    return plan


def pack(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, vocabulary: str = VOCABULARY, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """One row for each piece of a document: the window it goes to, its place there, and its tokens' range."""
    spark = docs.sparkSession
    bins = -(-window // grain)
    counted = lengths(docs, vocabulary, folder).where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id())
    kept = common.checkpoint(counted)
    rest = kept.withColumn("length", (F.col("n_tokens") % window).cast("int")).where("length > 0").withColumn("bin", F.ceil(F.col("length") / grain).cast("int"))
    ranked, histogram = _numbered(rest, "bin")
    allotted, used = [], np.zeros(bins + 1, np.int64)
    supply = np.array([histogram.get(b, 0) for b in range(1, bins + 1)], np.int64)
    for k, (combo, n) in enumerate(solve(supply, depth) if supply.any() else []):
        offset = slot = 0
        for b in sorted(set(combo)):
            m = combo.count(b)
            allotted.append((b, int(used[b]), int(used[b]) + n * m, m, k, slot, offset))
            used[b] += n * m
            slot, offset = slot + m, offset + m * b * grain
    plan = spark.createDataFrame(allotted, "key int, lo long, hi long, m int, combo int, slot0 int, offset0 int")
    placed = common.checkpoint(_placed(ranked, "bin", plan).select("row", "doc_id", "n_tokens", "length", "bin", "rank", "lo", "m", "combo", "slot0", "offset0"))
    at, copy = F.expr("(rank - lo) div m"), F.expr("cast((rank - lo) % m as int)")
    start = F.col("n_tokens") - F.col("length")
    combined = placed.where("combo is not null").select(
        F.concat_ws("-", F.lit("c"), "combo", at).alias("window_id"), (F.col("slot0") + copy).alias("slot"), (F.col("offset0") + copy * F.col("bin") * grain).alias("offset"), "doc_id", start.alias("start"), "length"
    )
    full = kept.where(F.col("n_tokens") >= window).withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_tokens div {window} - 1 as int)"))))
    full = full.select(F.concat_ws("-", F.lit("f"), "row", "k").alias("window_id"), F.lit(0).alias("slot"), F.lit(0).alias("offset"), "doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).alias("length"))
    left, counts = _numbered(placed.where("combo is null").select("row", "doc_id", "n_tokens", "length"), "length")
    plan = spark.createDataFrame(best_fit(counts, window), "key int, lo long, hi long, m int, first long, slot0 int, offset0 int")
    greedily = _placed(left, "length", plan).select(
        F.concat_ws("-", F.lit("r"), F.col("first") + at).alias("window_id"), (F.col("slot0") + copy).alias("slot"), (F.col("offset0") + copy * F.col("length")).alias("offset"), "doc_id", start.alias("start"), "length"
    )
    return combined.unionByName(full).unionByName(greedily)


def _numbered(pieces: DataFrame, key: str) -> tuple[DataFrame, dict[int, int]]:
    """pieces with their rank among those of the key, from 0, by (part, doc_id, row); and the number of each key."""
    parts = max(1, -(-pieces.count() // PART))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "row"), F.lit(parts)))
    counts = common.checkpoint(pieces.groupBy(key, "part").count())
    totals = {k: n for k, n in counts.groupBy(key).agg(F.sum("count")).collect()}  # one row a bin or length
    before = counts.select(key, "part", (F.sum("count").over(Window.partitionBy(key).orderBy("part")) - F.col("count")).alias("before"))
    number = F.row_number().over(Window.partitionBy(key, "part").orderBy("doc_id", "row")) - 1
    return pieces.join(before, [key, "part"]).withColumn("rank", number + F.col("before")), totals


def _placed(ranked: DataFrame, key: str, plan: DataFrame) -> DataFrame:
    """ranked with the run of the plan that its rank falls into; the plan is as small as the window."""
    return ranked.join(F.broadcast(plan), (F.col(key) == F.col("key")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack(common.table(spark, sf_dir, "documents"))
