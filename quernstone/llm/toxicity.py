"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Examples: at most ``max_examples`` labelled documents, half of each class where there are so many, chosen by a hash of
  their ids. This is the one bounded sample.
* Terms: all words of the examples. A term weighs (1 + ln tf) * idf * |ln of the ratio of its document rates in the two
  classes of examples|, by smoothed counts; document frequencies for idf are counted over all documents. A word that no
  example has occurs equally often in both classes, so its weight is 0 and nothing is left out. Vectors have length one.
  (Without the class ratio the neighbours say little about toxicity; the README has the figures.)
* Index: examples stand in blocks; each term has postings by block and the greatest weight in each block. For a query,
  blocks are visited in order of their bound, the sum over its terms of weight times block maximum, until the bound of
  the next is under the k-th similarity found: the k nearest are exact. The most frequent terms, which are in most
  blocks, are rows of a table instead of postings: one matrix product gives their part of all similarities of a batch of
  queries, and its maximum in a block is their part of the bound.
* Score: neighbours vote with weight 1 / (1.01 - similarity), so that a copy of an example outvotes the rest; slots
  without a neighbour of positive similarity vote with the base rate. The votes are calibrated by a logistic curve,
  fitted at the labelled base rate to votes on a fifth of the examples by an index of the others. A document is rejected at ``threshold``; its neighbours are the evidence.

Every document is a query, whole. Only (term, frequency) rows are shuffled. Defined cases: a document without a
neighbour (null, empty or wordless text, no term of an example) gets the labelled base rate as its score and is not
rejected; a null doc_id is kept; repeated rows are each scored; labels with a null field are left out, of repeated
labels for an id the greatest counts; of documents that share a labelled id the one of least text
hash is the example; equal similarities go by
example number. Without examples of both classes every score is the base rate (0 without labels) and nothing is
rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, words

MAX_EXAMPLES, K, THRESHOLD, BLOCK, STEP, AT_ONCE = 4096, 16, 0.7, 64, 16, 16
#: Terms of more than one in OFTEN examples, the DENSE most frequent at most, are held as rows of a table, not as postings.
OFTEN, DENSE = 16, 512
SCHEMA = "doc_id long, toxicity double, rejected boolean, neighbours array<long>, similarities array<double>"
NEAR_COPY = 0.9


@dataclass
class Index:
    """terms: sorted hashes. weight: idf * |log ratio|. Entry e is a (term, block): its postings are entry_at[e] to entry_at[e + 1]."""

    terms: np.ndarray
    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    base: float
    entry_term: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    entry_block: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    entry_max: np.ndarray = field(default_factory=lambda: np.zeros(1))  # the last, for no entry, is 0
    entry_at: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))
    term_at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # entries of term t: term_at[t] to term_at[t + 1]
    post_example: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint8))  # within its block
    post_weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    slope: float = 8.0
    shift: float = -4.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_dense"}

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(row of each term or -1, [rows, examples]): the weights of the most frequent terms; made once in each worker."""
        if "_dense" not in self.__dict__:
            df = np.diff(self.entry_at[self.term_at])
            often = np.flatnonzero(df * OFTEN > len(self.ids))
            often = often[np.argsort(-df[often], kind="stable")][:DENSE]
            row, table = np.full(len(self.terms), -1, np.int32), np.zeros((len(often), self.blocks * BLOCK))
            row[often] = np.arange(len(often))
            entry = np.repeat(np.arange(len(self.entry_term)), np.diff(self.entry_at[:-1]))
            r = row[self.entry_term[entry]]
            entry, use = entry[r >= 0], r >= 0
            table[r[use], self.entry_block[entry].astype(np.int64) * BLOCK + self.post_example[use]] = self.post_weight[use]
            self.__dict__["_dense"] = row, table
        return self.__dict__["_dense"]

    def fill(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Postings of the examples' vectors."""
        ex = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        order = np.lexsort((ex, term))
        ex, term, weight = ex[order], term[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (ex[1:] // BLOCK != ex[:-1] // BLOCK)])) if len(term) else np.empty(0, np.int64)
        self.entry_term, self.entry_block = term[new].astype(np.int32), (ex[new] // BLOCK).astype(np.int32)
        self.entry_max = np.append(np.maximum.reduceat(weight, new) if len(new) else np.empty(0), 0.0)
        self.entry_at = np.concatenate([new, [len(term), len(term)]]).astype(np.int64)
        self.term_at = np.searchsorted(self.entry_term, np.arange(len(self.terms) + 1))
        self.post_example, self.post_weight = (ex % BLOCK).astype(np.uint8), weight

    def vectors(self, text: np.ndarray, h: np.ndarray, n: int):
        """(bounds, term, weight) of n texts of which word h[i] is in text[i]."""
        at = np.minimum(np.searchsorted(self.terms, h), max(len(self.terms) - 1, 0))
        known = self.terms[at] == h if len(self.terms) else np.zeros(len(h), bool)
        return self.weigh(*words.unique_pairs(text[known], at[known]), n)

    def weigh(self, text: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int):
        w = (1 + np.log(tf)) * self.weight[term]
        norm = np.sqrt(np.bincount(text, w * w, minlength=n))
        return np.searchsorted(text, np.arange(n + 1)), term, w / norm[text]

    def nearest(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, prune: bool = True):
        """(examples, similarities), both [n, k], in order; -1 and 0 where fewer have a positive similarity.

        prune = False visits all blocks. A few queries are worked on at once, for the memory of postings.
        """
        n = len(bounds) - 1
        best, sim = np.full((n, k), -1, np.int64), np.zeros((n, k))
        for a in range(0, n, AT_ONCE):
            z = min(a + AT_ONCE, n)
            some = slice(bounds[a], bounds[z])
            best[a:z], sim[a:z] = self._nearest(bounds[a : z + 1] - bounds[a], term[some], weight[some], k, prune)
        return best, sim

    def _nearest(self, bounds: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, prune: bool):
        n, blocks = len(bounds) - 1, self.blocks
        best = np.full((n, k), -1, np.int64)
        sim = np.zeros((n, k))
        if not len(term) or not blocks:
            return best, sim
        row, table = self.dense()
        q, r = np.repeat(np.arange(n), np.diff(bounds)), row[term]
        given = np.zeros((n, len(table)))
        given[q[r >= 0], r[r >= 0]] = weight[r >= 0]
        known = given @ table  # [n, examples], of the frequent terms
        q, term, weight = q[r < 0], term[r < 0], weight[r < 0]
        many = self.term_at[term + 1] - self.term_at[term]
        entry = np.repeat(self.term_at[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        q, w, block = np.repeat(q, many), np.repeat(weight, many), self.entry_block[entry]
        bound = np.bincount(q * blocks + block, self.entry_max[entry] * w, minlength=n * blocks).reshape(n, blocks) + known.reshape(n, blocks, BLOCK).max(axis=2)
        order = np.argsort(-bound, axis=1, kind="stable")
        turn = np.argsort(order, axis=1)[q, block]
        active = np.arange(n)
        for step in range(0, blocks, STEP):
            top = bound[active, order[active, step]]
            active = active[(top > 0) & ((top >= sim[active, -1] - 1e-9) | (not prune))]
            if not len(active):
                break
            b = order[active, step : step + STEP]
            wide = b.shape[1]
            place = np.full(n, -1)
            place[active] = np.arange(len(active))
            hit = np.flatnonzero((turn >= step) & (turn < step + wide) & (place[q] >= 0))
            many = self.entry_at[entry[hit] + 1] - self.entry_at[entry[hit]]
            p = np.repeat(self.entry_at[entry[hit]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = (place[q[hit]] * wide + turn[hit] - step) * BLOCK
            dots = np.bincount(np.repeat(cell, many) + self.post_example[p], self.post_weight[p] * np.repeat(w[hit], many), minlength=len(active) * wide * BLOCK).reshape(len(active), -1)
            found = (b[:, :, None] * BLOCK + np.arange(BLOCK)).reshape(len(active), -1)
            dots = np.round(dots + known[active[:, None], found], 12)  # equal vectors are equal however they were added up
            both, who = np.concatenate([sim[active], dots], axis=1), np.concatenate([best[active], np.where(dots > 0, found, -1)], axis=1)
            if both.shape[1] > 4 * k:  # the k-th largest and all its equals, then the order of those alone
                least = -np.partition(-both, k - 1, axis=1)[:, k - 1 : k]
                width = int((both >= least).sum(axis=1).max())
                few = np.argpartition(-both, min(max(width, k), both.shape[1]) - 1, axis=1)[:, : max(width, k)]
                both, who = np.take_along_axis(both, few, 1), np.take_along_axis(who, few, 1)
            rank = np.lexsort((np.where(who < 0, 1 << 40, who), -both), axis=1)[:, :k]
            sim[active], best[active] = np.take_along_axis(both, rank, 1), np.take_along_axis(who, rank, 1)
        return best, sim

    def votes(self, best: np.ndarray, sim: np.ndarray) -> np.ndarray:
        w = 1 / (1.01 - np.minimum(sim, 1.0))
        y = np.where(best >= 0, self.labels[best], self.base) if len(self.labels) else np.full(best.shape, self.base)
        return (w * y).sum(axis=1) / w.sum(axis=1)

    def scores(self, best: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """The base rate where nothing was found."""
        found = 1 / (1 + np.exp(-(self.slope * self.votes(best, sim) + self.shift)))
        return np.where(best[:, 0] >= 0, found, self.base)


def _fit_curve(v: np.ndarray, y: np.ndarray, base: float) -> tuple[float, float]:
    """Logistic regression of y on v, classes weighted to the base rate, targets smoothed, by Newton's method."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    w = np.where(y == 1, base / n1, (1 - base) / n0) * len(y)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([v, np.ones_like(v)], 1), np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        g = x.T @ (w * (p - t)) + 1e-3 * np.array([beta[0], 0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, g)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def build_index(ids: np.ndarray, y: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf_of, base: float, k: int, fit: bool = True) -> Index:
    """ids, y, and the words terms[bounds[i]:bounds[i + 1]] with counts tf of each example. idf_of(hashes) gives their idf."""
    if not 0 < y.sum() < len(y):
        return Index(np.empty(0, np.uint64), np.empty(0), np.empty(0, np.int64), np.empty(0), base)
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(bounds))
    v, inv = np.unique(terms, return_inverse=True)
    inv = inv.astype(np.int32)
    a, b = np.bincount(inv, y[owner], len(v)), np.bincount(inv, 1 - y[owner], len(v))
    delta = np.abs(np.log((a + 0.5) / (y.sum() + 1)) - np.log((b + 0.5) / ((1 - y).sum() + 1)))
    idf = idf_of(v)
    curve = _calibrate(ids, y, bounds, terms, tf, v, idf, base, k) if fit else (8.0, -4.0)
    weight = idf * delta
    # blocks of one class and of examples with the same heaviest term, so that a block's maxima are those of few topics
    heavy = np.lexsort((-weight[inv] * (1 + np.log(tf)), owner))
    first = heavy[np.searchsorted(owner, np.arange(len(ids)))[np.diff(bounds) > 0]]
    topic = np.full(len(ids), -1, np.int64)
    topic[owner[first]] = inv[first]
    rank = np.lexsort((topic, y))
    place = np.empty(len(ids), np.int32)
    place[rank] = np.arange(len(ids))
    index = Index(v, weight, ids[rank], y[rank], base)
    order = np.lexsort((inv, place[owner]))
    bnd, term, w = index.weigh(place[owner][order], inv[order], tf[order], len(ids))
    used = w > 0  # a word as frequent in either class weighs nothing
    bnd = np.concatenate([[0], np.cumsum(used)])[bnd]
    term, w = term[used], w[used]
    index.fill(bnd, term, w)
    index.slope, index.shift = curve
    return index


def _calibrate(ids, y, bounds, terms, tf, v, idf, base: float, k: int) -> tuple[float, float]:
    """The curve for votes on every fifth example of each class by an index of the others; their copies don't vote."""
    fifth = np.zeros(len(y), bool)
    for c in (0, 1):
        fifth[np.flatnonzero(y == c)[4::5]] = True
    if not fifth.any() or not 0 < y[fifth].sum() < fifth.sum():
        return 8.0, -4.0
    owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
    rest = ~fifth[owner]
    n = np.diff(bounds)
    index = build_index(ids[~fifth], y[~fifth], np.concatenate([[0], np.cumsum(n[~fifth])]), terms[rest], tf[rest], lambda u: idf[np.searchsorted(v, u)], base, k, fit=False)
    votes = []
    for lo in range(0, len(y), 256):
        some = np.flatnonzero(fifth[lo : lo + 256]) + lo
        own = np.isin(owner, some)
        at = np.minimum(np.searchsorted(index.terms, terms[own]), len(index.terms) - 1)
        known = index.terms[at] == terms[own]
        text, term, count = np.searchsorted(some, owner[own][known]), at[known], tf[own][known]
        order = np.lexsort((term, text))
        best, sim = index.nearest(*index.weigh(text[order], term[order], count[order], len(some)), k)
        votes.append(index.votes(np.where(sim > NEAR_COPY, -1, best), np.where(sim > NEAR_COPY, 0, sim)))
    return _fit_curve(np.concatenate(votes), y[fifth], base)


def _bag(docs: DataFrame) -> DataFrame:
    """(doc_id, terms, tf) of documents."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bounds, terms, tfs, had = [np.zeros(1, np.int64)], [], [], 0
        for lo, hi, cps, offs in words.layouts(b.column("text")):
            text, _, _, h = words.words(cps, offs)
            t, term, tf = words.unique_pairs(text, h)
            bounds.append(had + np.searchsorted(t, np.arange(1, hi - lo + 1)))
            had += len(t)
            terms.append(term)
            tfs.append(tf)
        offs = pa.array(np.concatenate(bounds).astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(terms).view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(tfs)))], ["doc_id", "terms", "tf"])

    return common.each_batch(docs, batch, "doc_id long, terms array<long>, tf array<long>")


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """(documents with each of the sorted terms, number of documents), over all of them."""
    bc = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        v = bc.value
        df = np.zeros(len(v) + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for _, _, cps, offs in words.layouts(b.column("text")):
                text, _, _, h = words.words(cps, offs)
                at = np.minimum(np.searchsorted(v, h), max(len(v) - 1, 0))
                known = v[at] == h if len(v) else np.zeros(len(h), bool)
                df += np.bincount(words.unique_pairs(text[known], at[known])[1], minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["i", "n"])

    out = np.zeros(len(terms) + 1, np.int64)
    rows = common.map_arrow(docs.select("text"), count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # one row a term
    out[rows["i"].to_numpy()] = rows["n"].to_numpy()
    bc.unpersist()
    return out[:-1], int(out[-1])


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, k: int = K) -> Index:
    """The index of the labelled examples."""
    spark, docs = docs.sparkSession, common.text_of(docs)
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).dropna()
    given = given.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    base = float(given.agg(F.avg("toxic")).first()[0] or 0.0)
    pick = [given.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2) for c in (0, 1)]
    chosen = {r[0]: r[1] for p in pick for r in p.collect()}  # max_examples rows at most
    none = np.empty(0, np.int64)
    if not 0 < sum(chosen.values()) < len(chosen):
        return build_index(none, none, np.zeros(1, np.int64), none, none, None, base, k)
    wanted = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    own = docs.join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = _bag(own).toArrow()  # max_examples rows at most
    ids = rows["doc_id"].to_numpy()
    order = np.lexsort((ids, words.mix(ids.astype(np.uint64))))
    rows = rows.take(pa.array(order)).combine_chunks()
    ids = ids[order]
    y = np.array([chosen[i] for i in ids.tolist()], float)
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64))])
    terms, tf = (rows[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tf"))

    def idf(vocabulary: np.ndarray) -> np.ndarray:
        df, n = document_frequencies(docs, vocabulary)
        return np.log(max(n, 1) / np.maximum(df, 1)) + 1

    index = build_index(ids, y, bounds, terms.view(np.uint64), tf, idf, base, k)
    del rows, terms, tf
    common.give_back()
    return index


def _search(index: Index, col: pa.Array, k: int):
    for lo, hi, cps, offs in words.layouts(col):
        text, _, _, h = words.words(cps, offs)
        yield lo, hi, *index.nearest(*index.vectors(text, h, hi - lo), k)


def scores(docs: DataFrame, index: Index, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Score, decision and evidence (neighbours, nearest first) of every document."""
    bc = docs.sparkSession.sparkContext.broadcast(index)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        score, near, sims, lens, rejected = [], [], [], [], []
        for _, _, best, sim in _search(bc.value, b.column("text"), k):
            score.append(bc.value.scores(best, sim))
            has = best >= 0
            rejected.append(has[:, 0] & (score[-1] >= threshold))
            lens.append(has.sum(axis=1))
            near.append(bc.value.ids[best[has]] if len(bc.value.ids) else np.empty(0, np.int64))
            sims.append(sim[has])
        s = np.concatenate(score)
        offs = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(np.concatenate(rejected)), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(near).astype(np.int64))), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(sims)))], ["doc_id", "toxicity", "rejected", "neighbours", "similarities"])

    return common.each_batch(common.text_of(docs), batch, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, k: int = K, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The documents, with all their columns, that aren't rejected. No join and no shuffle of documents."""
    bc = docs.sparkSession.sparkContext.broadcast(train(docs, labels, k=k, **training))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = np.concatenate([(best[:, 0] < 0) | (bc.value.scores(best, sim) < threshold) for _, _, best, sim in _search(bc.value, b.column("text"), k)])
        return b.filter(pa.array(keep)) if keep.any() else None

    return common.each_batch(docs, batch, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, decision and evidence of all documents, from the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
