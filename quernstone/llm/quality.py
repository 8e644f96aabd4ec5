"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

* Indicators, hashed to 2^18: words and pairs of words (case ignored), runs of three characters, and runs of one to
  three word forms. A word's form is its case, its kind (letters, digits), whether it repeats the word before, and the
  kind of what stands between it and the next word.
* Each indicator is scaled by its class log-count ratio, vectors are scaled to length one, and a linear model of least
  squared hinge loss is fitted by dual coordinate descent. A logistic curve, fitted on a held-out fifth, gives the
  probability of good quality; below ``threshold`` a document is not kept.
* The model is fitted on at most ``max_rows`` labelled documents, chosen by a hash of their ids: the one bounded sample.
  All documents are scored, whole, in one pass without a shuffle.

Defined cases: a null or empty text has no indicators and gets the model's bias; a null doc_id is kept; repeated rows
are each scored; labels with a null field are left out, of repeated labels for an id the least counts; of documents
that share a labelled id the one of least text hash is fitted on; where the labelled documents found aren't of both
classes every document gets the rate of good labels (1 without labels) and is kept; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, words

BITS, MAX_ROWS, THRESHOLD, COST, EPOCHS = 18, 8192, 0.5, 1.0, 20
SCHEMA = "doc_id long, quality double, keep boolean"
_kinds: list[np.ndarray] = []


def _upper() -> np.ndarray:
    if not _kinds:
        _kinds.append(np.fromiter((chr(c).isupper() for c in range(0x30000)), bool, 0x30000))
    return _kinds[0]


def indicators(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) in that order, each once."""
    text, start, end, h = words.words(cps, offs)
    parts: list[tuple[np.ndarray, np.ndarray]] = [(text, words.mix(h + np.uint64(1)))]
    at, g = words.ngrams(text, h, 2)
    parts.append((text[at], words.mix(g + np.uint64(2))))
    if len(cps) >= 3:
        whose = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        one = whose[2:] == whose[:-2]
        c = cps.astype(np.uint64)
        parts.append((whose[:-2][one], words.mix((c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))[one] + np.uint64(3))))
    if len(h):
        big = np.concatenate([[0], np.cumsum(_upper()[np.minimum(cps, 0x2FFFF)])])
        digit = np.concatenate([[0], np.cumsum((cps >= 48) & (cps <= 57))])
        n_up, n = big[end] - big[start], end - start
        case = np.where(n_up == 0, 0, np.where((n_up == n) & (n > 1), 2, 1)) + 3 * (digit[end] > digit[start])
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])
        last = np.concatenate([text[1:] != text[:-1], [True]])
        stop = np.where(last, offs[text + 1], np.concatenate([start[1:], [len(cps)]]))
        after = np.where(end < stop, cps[np.minimum(end, len(cps) - 1)], 0).astype(np.int64)
        gap = np.minimum(stop - end, 4)
        form = (case + 6 * again.astype(np.int64) + 12 * gap + 60 * (after & 0xFFFF)).astype(np.uint64)
        form = words.mix(form + np.uint64(4))
        parts.append((text, form))
        for k in (2, 3):
            at, g = words.ngrams(text, form, k)
            parts.append((text[at], words.mix(g + np.uint64(5 + k))))
    t = np.concatenate([p[0] for p in parts]).astype(np.int64)
    b = np.concatenate([(p[1] >> np.uint64(64 - BITS)).astype(np.int64) for p in parts])
    pair = np.unique((t << BITS) | b)
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray  # of each indicator, its log-count ratio included
    square: np.ndarray  # of the log-count ratio
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    rate: float | None = None  # what every document gets, where there is nothing to fit

    def margins(self, text: np.ndarray, ind: np.ndarray, n: int) -> np.ndarray:
        s, q = np.bincount(text, self.weight[ind], n), np.bincount(text, self.square[ind], n)
        return s / np.sqrt(np.maximum(q, 1e-12)) + self.bias

    def quality(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def dual_descent(bounds: np.ndarray, ind: np.ndarray, x: np.ndarray, y: np.ndarray, dim: int, cost: float, epochs: int) -> np.ndarray:
    """Weights, the last for the bias, of least w.w / 2 + sum of cost * max(0, 1 - y w.x) ** 2. Classes weigh alike."""
    c = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, alpha = np.zeros(dim + 1), np.zeros(len(y))
    square = np.add.reduceat(np.append(x * x, 0.0), np.minimum(bounds[:-1], len(x))) * (np.diff(bounds) > 0) + 1.0 + 1 / (2 * c)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            a, b = bounds[i], bounds[i + 1]
            j, v = ind[a:b], x[a:b]
            g = y[i] * (w[j] @ v + w[dim]) - 1 + alpha[i] / (2 * c[i])
            if alpha[i] == 0 and g >= 0:
                continue
            worst = max(worst, abs(g))
            new = max(alpha[i] - g / square[i], 0.0)
            step = (new - alpha[i]) * y[i]
            alpha[i] = new
            w[j] += step * v
            w[dim] += step
        if worst < 0.01:
            break
    return w


def fit(bounds: np.ndarray, ind: np.ndarray, good: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """The model of rows ind[bounds[i]:bounds[i + 1]]; every fifth row is held out for the logistic curve."""
    n, dim = len(good), 1 << BITS
    train = np.arange(n) % 5 != 4
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
    used = train[owner]
    p = np.bincount(ind[used & good[owner]], minlength=dim) + 1.0
    q = np.bincount(ind[used & ~good[owner]], minlength=dim) + 1.0
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = ratio.astype(np.float32)[ind]
    norm = np.sqrt(np.maximum(np.bincount(owner, x * x, n), 1e-12)).astype(np.float32)
    x /= norm[owner]
    counts = np.diff(bounds)[train]
    y = np.where(good, 1.0, -1.0)
    w = dual_descent(np.concatenate([[0], np.cumsum(counts)]), ind[used], x[used], y[train], dim, cost, epochs)
    model = Model(w[:dim] * ratio, ratio**2, float(w[dim]))
    held = ~train if good[~train].any() and not good[~train].all() else train
    some = held[owner]
    m, t = model.margins(owner[some], ind[some], n)[held], good[held].astype(float)
    n1, n0 = t.sum(), (1 - t).sum()
    t = np.where(t > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z, beta = np.stack([m, np.ones_like(m)], 1), np.array([2.0, 0.0])
    for _ in range(60):
        pr = 1 / (1 + np.exp(-np.clip(z @ beta, -500, 500)))
        hess = (z * (pr * (1 - pr))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (pr - t) + 1e-3 * beta)
        beta -= step * min(1.0, 3.0 / max(np.abs(step).max(), 1e-12))
    model.slope, model.shift = float(beta[0]), float(beta[1])
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    spark = docs.sparkSession
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    given = given.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = {r[0]: r[1] > 0 for r in given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()}
    flat = Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, rate=float(np.mean(list(chosen.values()))) if chosen else 1.0)
    if not 0 < sum(chosen.values()) < len(chosen):
        return flat

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        lens, inds = [], []
        for lo, hi, cps, offs in words.layouts(b.column("text")):
            t, i = indicators(cps, offs)
            lens.append(np.bincount(t, minlength=hi - lo))
            inds.append(i)
        offs = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int32))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(inds).astype(np.int32)))], ["doc_id", "ind"])

    wanted = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    own = common.text_of(docs).join(F.broadcast(wanted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = common.each_batch(own, batch, "doc_id long, ind array<int>").toArrow()  # max_rows rows at most
    if not 0 < sum(chosen[i] for i in rows["doc_id"].to_pylist()) < len(rows):
        return flat
    ids = rows["doc_id"].to_numpy()
    order = np.lexsort((ids, words.mix(ids.astype(np.uint64))))
    rows = rows.take(pa.array(order)).combine_chunks()
    lists = rows["ind"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offs = lists.offsets.to_numpy().astype(np.int64)
    good = np.array([chosen[i] for i in ids[order].tolist()])
    return fit(offs - offs[0], lists.flatten().to_numpy(), good)


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Probability of good quality, and the decision, of every document."""
    bc = docs.sparkSession.sparkContext.broadcast(model)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        q = []
        for lo, hi, cps, offs in words.layouts(b.column("text")):
            t, i = indicators(cps, offs)
            q.append(bc.value.quality(bc.value.margins(t, i, hi - lo)))
        quality = np.concatenate(q)
        flat = bc.value.rate is not None
        if flat:
            quality[:] = bc.value.rate
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(quality), pa.array((quality >= threshold) | flat)], ["doc_id", "quality", "keep"])

    return common.each_batch(common.text_of(docs), batch, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the model of the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
