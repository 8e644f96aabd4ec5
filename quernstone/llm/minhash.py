"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

* Shingles are runs of ``shingle`` words (letters and digits, case ignored); a shorter text is one shingle. A shingle's
  weight is its count times its idf. Document frequencies of shingles are counted over all documents, in 2^20 buckets by
  hash, so that the table on the executors has one size whatever the corpus: a shingle gets the frequency of its bucket.
* A document's sketch is ``bands * rows`` consistent weighted samples: the (shingle, t) of least ln c - r (t - beta + 1),
  with t = floor(ln w / r + beta). The draws come from a hash of (shingle, sample): r and c are Gamma(2, 1) at 16 bits
  of it each, by a table of quantiles, beta is uniform at the other 32.
* Documents that agree in all rows of a band share a bucket. Each is compared with the bucket's leader, its least
  (doc_id, text hash): one edge a member, however large the bucket. Then the pairs of a bucket that aren't connected yet
  are compared (see graph.star_edges), so that a bucket loses nothing. Of documents of the same words one goes there.
* A pair is verified by the weighted Jaccard similarity of the whole texts: sum of least weights over sum of greatest.
  Texts of the same words are equal without that. Verified edges make groups (connected components).

Pairs of similarity s meet with probability 1 - (1 - s^rows)^bands: 0.93 at the threshold, 0.98 at 0.6, 1.00 at 0.7.
Defined cases: a null, empty or wordless text is in no group and stays; a null doc_id orders after all others; of equal
rows (same doc_id and text) one stays; ties are broken by text hash; other columns are ignored and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, graph, words

SHINGLE, BANDS, ROWS, THRESHOLD = 2, 28, 4, 0.55
BUCKET_BITS, SALT = 20, 4000
_SLICE = 1024
_draws: list[np.ndarray] = []


def draws() -> list[np.ndarray]:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal shares, and their logarithms."""
    if not _draws:
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        low, high = np.zeros(1 << 16), np.full(1 << 16, 64.0)
        for _ in range(60):
            mid = (low + high) / 2
            over = 1 - (1 + mid) * np.exp(-mid) > u
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        _draws.extend((low.astype(np.float32), np.log(low).astype(np.float32)))
    return _draws


def shingles(cps: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) of every shingle, texts in order; and 128 bits of hash of each text's words, 0 for none."""
    text, _, _, h = words.words(cps, offs)
    n_texts = len(offs) - 1
    count = np.bincount(text, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    content = np.zeros((n_texts, 2), np.uint64)
    if len(h):
        place = words.mix((np.arange(len(h)) - first[text]).astype(np.uint64) + np.uint64(77))
        has = np.flatnonzero(count)
        content[has, 0] = np.add.reduceat(words.mix(h ^ place), first[has]) | np.uint64(1)
        content[has, 1] = np.add.reduceat(words.mix(words.mix(h + np.uint64(5)) ^ ~place), first[has])
    at, g = words.ngrams(text, h, shingle)
    t = text[at]
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        t, g = np.concatenate([t, short]), np.concatenate([g, content[short, 0]])
        order = np.argsort(t, kind="stable")
        t, g = t[order], g[order]
    return t, g, content


def document_frequencies(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, int]:
    """(documents that have a shingle of the bucket, for each bucket; number of documents). A task's table travels in slices."""
    n_slices, mask = (1 << BUCKET_BITS) // _SLICE, np.uint64((1 << BUCKET_BITS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BUCKET_BITS, np.int32), 0
        for b in batches:
            n += b.num_rows
            for _, _, cps, offs in words.layouts(b.column("text")):
                text, g, _ = shingles(cps, offs, shingle)
                pair = np.unique((text.astype(np.uint64) << np.uint64(BUCKET_BITS)) | (g >> np.uint64(64 - BUCKET_BITS)))
                np.add.at(df, (pair & mask).astype(np.int64), 1)
        if n:
            table = df.reshape(n_slices, _SLICE)
            at = np.flatnonzero(table.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int32()), pa.array([np.int32(n).tobytes(), *(table[i].tobytes() for i in at)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of slice, one sum a slice."""
        last, total = None, None
        done: list[tuple[int, bytes]] = []
        for b in batches:
            for i, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                if i != last:
                    if last is not None:
                        done.append((last, total.tobytes()))
                    last, total = i, np.zeros(len(x) // 4, np.int64)
                total += np.frombuffer(x, np.int32)
        if last is not None:
            done.append((last, total.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], pa.int32()), pa.array([x for _, x in done], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    df, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
    summed = common.map_arrow(common.map_arrow(docs.select("text"), count, schema).repartition("slice").sortWithinPartitions("slice"), add, schema)
    rows = summed.toArrow()  # 1025 rows at most
    for i, counts in zip(rows["slice"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        if i < 0:
            n = int(np.frombuffer(counts, np.int64)[0])
        else:
            df[i * _SLICE : (i + 1) * _SLICE] = np.frombuffer(counts, np.int64)
    return df, n


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p(n / (df + 1.0)).astype(np.float32)


def weighted(cps: np.ndarray, offs: np.ndarray, idf: np.ndarray, shingle: int = SHINGLE):
    """(text, shingle, weight) in that order, each once; and 128 bits of hash of each text's words, 0 for none."""
    t, g, content = shingles(cps, offs, shingle)
    t, g, tf = words.unique_pairs(t, g)
    return t, g, idf[(g >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)] * tf.astype(np.float32), content


def sketch(g: np.ndarray, w: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples, as hashes, of each set g[bounds[i]:bounds[i + 1]]; no set is empty."""
    gamma, log_gamma = draws()
    lnw = np.log(w)
    low = (g ^ (g >> np.uint64(32))).astype(np.uint32)
    seeds = words.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(bounds), n), np.uint64)
    for k in range(n):
        h = g * seeds[k]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        r = gamma[h >> np.uint64(48)]
        a = log_gamma[(h >> np.uint64(32)).astype(np.uint16)]
        beta = h.astype(np.uint32).astype(np.float32)
        beta *= np.float32(2.0**-32)
        t = lnw / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        a += beta  # ln c - r (t - beta + 1)
        a += np.float32(128)  # positive, so that its bits order as it does
        key = a.view(np.uint32).astype(np.uint64)
        key <<= np.uint64(32)
        key |= low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[:, k] = np.minimum.reduceat(key, bounds) & np.uint64(0xFFFFFFFF)
    return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(samples), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(samples), b + 1, np.uint64)
        for j in range(rows):
            h = words.mix(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * rows + j])
        out[:, b] = h
    return out


def signatures(docs: DataFrame, idf, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, k1, k2, c1, c2, buckets) of every document that has words."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        at, content, hashes = [], [], []
        for lo, _, cps, offs in words.layouts(b.column("text")):
            t, g, w, c = weighted(cps, offs, idf.value, shingle)
            if len(t):
                bounds = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                at.append(lo + t[bounds])
                content.append(c[t[bounds]])
                hashes.append(band_hashes(sketch(g, w, bounds, bands * rows), bands, rows))
        if not at:
            return None
        take = pa.array(np.concatenate(at))
        flat = np.concatenate(hashes).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32)), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("doc_id", "k1", "k2")), *(pa.array(np.concatenate(content)[:, i].view(np.int64)) for i in (0, 1)), lists], ["doc_id", "k1", "k2", "c1", "c2", "buckets"])

    return common.each_batch(common.text_of(docs).select("doc_id", "text", *common.keys()), batch, "doc_id long, k1 long, k2 long, c1 long, c2 long, buckets array<long>")


def _verify(docs: DataFrame, edges: DataFrame, idf, shingle: int, threshold: float) -> DataFrame:
    """The edges (a1, a2) - (b1, b2) whose texts reach the threshold, with their similarity."""
    size = edges.groupBy("b1", "b2").count().select("b1", "b2", F.ceil(F.col("count") / SALT).alias("salts"))
    salted = edges.join(size, ["b1", "b2"]).select("a1", "a2", "b1", "b2", F.pmod("a1", "salts").alias("salt"), "salts")
    leaders = size.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), "b1", "b2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("ord"))
    wanted = leaders.unionByName(salted.select("a1", "a2", "b1", "b2", "salt", F.lit(1).alias("ord")))
    texts = common.text_of(docs).select("text", *common.keys())
    sent = texts.join(common.small(wanted, 64), (F.col("k1") == F.col("a1")) & (F.col("k2") == F.col("a2"))).select("a1", "a2", "b1", "b2", "salt", "ord", "text")
    sent = sent.repartition("b1", "b2", "salt").sortWithinPartitions("b1", "b2", "salt", "ord")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, mine, weight, total = None, np.empty(0, np.uint64), np.empty(0, np.float32), 0.0
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("b1", "b2", "salt", "ord")]
            out: list[tuple[int, float]] = []
            for lo, hi, cps, offs in words.layouts(b.column("text")):
                t, g, w, _ = weighted(cps, offs, idf.value, shingle)
                bounds = np.searchsorted(t, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    x, y = bounds[i], bounds[i + 1]
                    own = (cols[0][lo + i], cols[1][lo + i], cols[2][lo + i])
                    if cols[3][lo + i] == 0:
                        if lead != own:
                            lead, mine, weight, total = own, g[x:y].copy(), w[x:y].copy(), float(w[x:y].sum(dtype=np.float64))
                        continue
                    p = np.minimum(np.searchsorted(mine, g[x:y]), max(len(mine) - 1, 0))
                    both = mine[p] == g[x:y] if len(mine) else np.zeros(y - x, bool)
                    least = float(np.minimum(weight[p[both]], w[x:y][both]).sum(dtype=np.float64))
                    union = total + float(w[x:y].sum(dtype=np.float64)) - least
                    if union > 0 and least / union >= threshold:
                        out.append((lo + i, least / union))
            if out:
                take = pa.array([i for i, _ in out])
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("a1", "a2", "b1", "b2")), pa.array([s for _, s in out])], ["a1", "a2", "b1", "b2", "similarity"])

    return common.map_arrow(sent, compare, "a1 long, a2 long, b1 long, b2 long, similarity double").dropDuplicates(["a1", "a2", "b1", "b2"])


def groups(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, k1, k2, group_id, links, similarity, keep) of each document in a group of two or more.

    group_id: the doc_id that stays, the least of the group. links: the document's verified links, of those that join
    its group (pairs that others connect aren't compared). similarity: the greatest of them.
    """
    sc = docs.sparkSession.sparkContext
    idf = sc.broadcast(idf_of(*document_frequencies(common.text_of(docs), shingle)))
    sig = common.checkpoint(signatures(docs, idf, shingle, bands, rows))
    node = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("d"), "k1", "k2").alias("v")
    nodes = sig.dropDuplicates(["k1", "k2"]).select(node, "c1", "c2", "buckets")
    firsts = common.checkpoint(nodes.groupBy("c1", "c2").agg(F.min(F.struct("v", "buckets")).alias("f"), F.count("*").alias("n")))
    same = firsts.where("n > 1").select("c1", "c2", F.col("f.v").alias("u"))
    copies = nodes.join(same, ["c1", "c2"]).where("v <> u").select("v", "u", F.lit(1.0).alias("similarity"))
    members = firsts.select("f.v", F.explode("f.buckets").alias("bucket"))
    edges = common.checkpoint(copies.unionByName(graph.star_edges(members, lambda pairs: _edges(docs, pairs, idf, shingle, threshold))))
    best = edges.select("v", "similarity").unionByName(edges.select(F.col("u").alias("v"), "similarity")).groupBy("v").agg(F.count("*").alias("links"), F.max("similarity").alias("similarity"))
    idf.unpersist()
    label = graph.components(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    out = best.join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
    doc = lambda c: F.when(~F.col(f"{c}.n"), F.col(f"{c}.d"))
    return out.select(doc("v").alias("doc_id"), "v.k1", "v.k2", doc("label").alias("group_id"), "links", "similarity", (F.col("v") == F.col("label")).alias("keep"))


def _edges(docs: DataFrame, pairs: DataFrame, idf, shingle: int, threshold: float) -> DataFrame:
    """(v, u, similarity) of the pairs that are near enough."""
    keyed = pairs.select("v", "u", F.col("v.k1").alias("a1"), F.col("v.k2").alias("a2"), F.col("u.k1").alias("b1"), F.col("u.k2").alias("b2"))
    found = _verify(docs, keyed.select("a1", "a2", "b1", "b2"), idf, shingle, threshold)
    return keyed.join(found, ["a1", "a2", "b1", "b2"]).select("v", "u", "similarity")


def drop_near_duplicates(docs: DataFrame, **parameters) -> DataFrame:
    """The documents, with all their columns, without those of which another of the group stays."""
    drop = groups(docs, **parameters).where("not keep").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    keyed = common.keyed(docs).join(drop, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_anti")
    return common.one_of_equal(keyed).select("d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of near duplicates among the documents."""
    return groups(common.table(spark, sf_dir, "documents")).select("doc_id", "group_id", "links", "similarity", "keep")
