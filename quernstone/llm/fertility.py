"""Quality rules by tokeniser fertility.

Public vocabularies measure each document: characters per token (of the byte-level vocabulary and of the piece-based
one), the share of byte-fallback tokens (of the piece-based one), and the entropy of the tokens as a share of the
greatest possible, log2 of their number. Bands are made for each language and octave of length (floor of log2 of the
tokens, as spread and entropy depend on length), from all its documents: the median, less or plus ``width`` times the
distance to the quartile on that side (at least ``floor``). A document of at least ``min_tokens`` tokens outside of a
band is rejected; reasons names the bands. A group of fewer than ``min_group`` documents gets the bands of the first of
LEVELS that has as many: the octaves about it, its language, those octaves of all languages, all documents. Only a table
of fewer than ``min_group`` documents in all has no bands.

One pass over the texts; what is shuffled is quantile sketches, a row for each group. Defined cases: a null or empty text
has no tokens, null measures, and is kept; a null language is a group of its own; a null doc_id is kept; repeated rows
are each measured; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, tokens

BYTES, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
MIN_TOKENS, MIN_GROUP, WIDTH = 1, 30, 6.0
#: (whether of one language, octaves on either side; None: all) of the pools that a group may take its bands from, best first.
LEVELS = ((True, 0), (True, 1), (True, 2), (True, None), (False, 1), (False, None))
#: Measure: (side of the band: low, high or both; least distance to a quartile).
BANDS = {"chars_per_token": ("both", 0.1), "piece_chars_per_token": ("both", 0.1), "byte_share": ("high", 0.01), "entropy": ("low", 0.02)}
MEASURES = "doc_id long, lang string, n_tokens long, chars_per_token double, piece_chars_per_token double, byte_share double, entropy double"


def entropies(ids: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Entropy in bits of the ids of each text, 0 for none."""
    n = len(offs) - 1
    if not len(ids):
        return np.zeros(n)
    text = np.repeat(np.arange(n), np.diff(offs))
    pair, count = np.unique(text * size + ids, return_counts=True)
    t = pair // size
    p = count / np.diff(offs)[t]
    return np.bincount(t, -p * np.log2(p), n)


def measure(docs: DataFrame, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """The measures of every document; see MEASURES."""
    sc = docs.sparkSession.sparkContext
    data = {name: sc.broadcast(tokens.read_file(folder, name)) for name in (BYTES, PIECES)}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        col = b.column("text")
        chars = pc.utf8_length(pc.fill_null(col, "")).to_numpy(zero_copy_only=False).astype(float)
        v, s = (tokens.load(name, data[name].value) for name in (BYTES, PIECES))
        ids, offs = v.encode(col)
        n = np.diff(offs).astype(float)
        bits = entropies(ids, offs, v.size)
        ids, offs = s.encode(col)
        m = np.diff(offs).astype(float)
        fallback = np.diff(np.concatenate([[0], np.cumsum(s.is_byte[ids])])[offs])
        none = n == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            cols = [chars / n, chars / m, fallback / m, np.where(n > 1, bits / np.log2(n), 1.0)]
        out = [b.column("doc_id"), b.column("lang"), pa.array(n.astype(np.int64)), *(pa.array(c, mask=none) for c in cols)]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "lang", "n_tokens", *BANDS])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return common.each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")), batch, MEASURES)


def _edges(width: float) -> list[Column]:
    out = []
    for name, (side, floor) in BANDS.items():
        q = F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10_000)
        low = q[1] - width * F.greatest(q[1] - q[0], F.lit(floor)) if side != "high" else F.lit(float("-inf"))
        high = q[1] + width * F.greatest(q[2] - q[1], F.lit(floor)) if side != "low" else F.lit(float("inf"))
        out += [low.alias(f"{name}_low"), high.alias(f"{name}_high")]
    return out


def _pool(level: int, octave: Column) -> Column:
    """The name of a pool; names sort by level."""
    lang = F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("is "), "lang")) if LEVELS[level][0] else F.lit("any")
    return F.concat_ws(":", F.lit(level), octave, lang)


def bands(measured: DataFrame, min_tokens: int = MIN_TOKENS, min_group: int = MIN_GROUP, width: float = WIDTH) -> DataFrame:
    """The bands of each (language, octave), from the first of its pools that has enough documents."""
    long = measured.where(F.col("n_tokens") >= max(min_tokens, 1)).withColumn("octave", _octave())
    groups = common.checkpoint(long.groupBy("lang", "octave").agg(F.count("*").alias("n")))
    gives, takes = [], []
    for i, (_, far) in enumerate(LEVELS):
        gives += [_pool(i, F.lit(0))] if far is None else [_pool(i, F.col("octave") + d) for d in range(-far, far + 1)]
        takes.append(_pool(i, F.lit(0) if far is None else F.col("octave")))
    given = groups.select("lang", "octave", "n", F.explode(F.array(*gives)).alias("pool"))
    enough = given.groupBy("pool").agg(F.sum("n").alias("size")).where(F.col("size") >= min_group)
    taken = groups.select("lang", "octave", F.explode(F.array(*takes)).alias("pool")).join(enough, "pool").groupBy("lang", "octave").agg(F.min("pool").alias("pool"))
    taken = common.checkpoint(taken)
    used = given.join(taken.select("pool").distinct(), "pool", "left_semi").groupBy("lang", "octave").agg(F.collect_list("pool").alias("pools"))
    used = common.checkpoint(used.select(F.col("lang").alias("_lang"), F.col("octave").alias("_octave"), "pools"))
    rows = long.join(common.small(used, 1024), F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("octave") == F.col("_octave")))
    made = rows.withColumn("pool", F.explode("pools")).groupBy("pool").agg(F.count("*").alias("n_documents"), *_edges(width))
    return taken.join(made, "pool").drop("pool")


def _octave() -> Column:
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")


def judge(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_group: int = MIN_GROUP, width: float = WIDTH, folder: str = tokens.TOKENIZERS) -> DataFrame:
    """Measures, decision and reasons of every document."""
    measured = common.checkpoint(measure(docs, folder))
    edges = [f"{m}_{side}" for m in BANDS for side in ("low", "high")]
    own = common.checkpoint(bands(measured, min_tokens, min_group, width).select(F.col("lang").alias("_lang"), "octave", *edges))
    joined = measured.join(common.small(own, 256), F.col("lang").eqNullSafe(F.col("_lang")) & (_octave() == F.col("octave")), "left")
    outside = [F.when((F.col(m) < F.col(f"{m}_low")) | (F.col(m) > F.col(f"{m}_high")), F.lit(m)) for m in BANDS]
    reasons = F.when(F.col("n_tokens") >= min_tokens, F.array_compact(F.array(*outside))).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("reasons", reasons).select("doc_id", "n_tokens", *BANDS, "reasons", (F.size("reasons") == 0).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the bands of their languages."""
    return judge(common.table(spark, sf_dir, "documents"))
